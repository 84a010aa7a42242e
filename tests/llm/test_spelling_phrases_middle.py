"""Spelling variants, removal of repeated passages and fill-in-middle against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from skyframe.llm import fill_in_middle, phrases, spelling

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LONG = " ".join(f"word{i}é" for i in range(60_000))
ODD = [(None, "alone without an id, wordly wordly"), (None, None), (1, None), (2, ""), (3, LONG), (4, "the same text again and again here"), (4, "the same text again and again here"),
       (4, "another text"), (6, " \t\n "), (7, "x" * 200_000), (8, " Ünïcode\u0000 — 𝒳 text <|endoftext|> 'quoted' "), (9, "has <S> in it"), (10, LONG)]
CLASH = ["n", "form", "word", "root", "anchor", "anchors", "copy", "spans", "common", "passage", "output", "i", "w", "at", "size", "x", "slice"]


def table(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    return df.select("*", *(F.lit(f"clash-{c}").alias(c) for c in CLASH))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words_by_hand(rows):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def near_by_hand(words):
    """Near words by deleting letters: two words one edit apart share a deletion, or one is a deletion of the other."""
    by = {}
    for w in words:
        for i in range(len(w)):
            by.setdefault((i, w[:i] + "\0" + w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for group in by.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in near:
                near[w].add(shorter)
                near[shorter].add(w)
    return near


def variants_by_hand(n):
    near = near_by_hand(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def rows_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_query_of_variants_on_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = entry_point.queries()["op11_spelling_variants"](spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants_by_hand(words_by_hand(rows))
    assert rows_of(got) == want and any(v[0] for v in want.values())


@pytest.mark.parametrize("size", [8192, 7])
def test_variants_in_slices(spark, monkeypatch, size):
    monkeypatch.setattr(spelling, "SLICE", size)
    monkeypatch.setattr(spelling, "ROWS", 5)
    rng = random.Random(2)
    stems = ["".join(rng.choice("abcnrtéÿ") for _ in range(rng.randint(5, 8))) for _ in range(40)]
    n = {}
    for s in stems:
        n[s] = rng.randint(1, 9000)
        for _ in range(12):
            i = rng.randrange(len(s))
            n[rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abxyz") + s[i + 1 :], s[:i] + rng.choice("abxyz") + s[i:]])] = rng.choice([1, 5, 25, 125, 625])
    got = rows_of(spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n bigint")))
    assert got == variants_by_hand(n)
    assert max(len(v) for v in near_by_hand(n).values()) > 5


def test_chains_of_forms(spark):
    n = {"aaaaaa" + "b" * i: 7**i for i in range(12)}
    got = rows_of(spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n bigint")))
    assert {v[1] for v in got.values()} == {"aaaaaa" + "b" * 11}


def test_ties_take_the_smallest_word(spark):
    n = {"colour": 1, "colouré": 50, "colourz": 50, "dolour": 50}
    got = rows_of(spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n bigint")))
    assert got["colour"] == ("colourz", "colourz", 1, 3, 50)


def test_one_edit():
    assert spelling.one_edit("abc", "abd") and spelling.one_edit("abc", "abxc") and spelling.one_edit("abcd", "abc")
    assert not spelling.one_edit("abc", "abc") and not spelling.one_edit("abc", "acb") and not spelling.one_edit("abc", "abcde")


def test_variants_of_odd_rows(spark):
    rows = ODD + [(20 + i, "Behaviour behavior") for i in range(6)] + [(None, "wordly")] * 5
    assert rows_of(spelling.variants(table(spark, rows))) == variants_by_hand(words_by_hand(rows))
    assert spelling.variants(table(spark, [])).collect() == []


def removed_by_hand(rows, window=13):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for j in range(len(w) - window + 1):
                g = tuple(w[j : j + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        keep = [True] * len(w)
        if i is not None:
            for j in range(len(w) - window + 1):
                if first[tuple(w[j : j + window])] < i:
                    keep[j : j + window] = [False] * window
        out.append((i, len(w), len(w) - sum(keep), " ".join(x for x, k in zip(w, keep, strict=True) if k)))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def removal(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()), key=key)


def passages(seed, n):
    """Texts from few words with shared passages, so that windows overlap, nest and recur in one document."""
    rng = random.Random(seed)
    shared = [[f"s{rng.randrange(400)}" for _ in range(rng.randint(5, 60))] for _ in range(12)] + [["a"] * 30, ["a", "b"] * 20]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(shared) if rng.random() < 0.6 else [f"u{rng.random()}" for _ in range(rng.randint(1, 30))]
        a = rng.randint(0, 3)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words[a:])))
    return rows


@pytest.mark.parametrize("common", [65_536, 3, 60])
@pytest.mark.parametrize("shard", [150_000, 200])
def test_repeats_against_brute_force(spark, monkeypatch, common, shard):
    monkeypatch.setattr(phrases, "SHARD", shard)
    rows = passages(common, 300)
    got = removal(phrases.remove_repeats(table(spark, rows, 7), common=common))
    want = sorted(removed_by_hand(rows), key=key)
    assert got == want and sum(r[2] for r in want) > 1000


def test_repeats_on_odd_rows(spark):
    again = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = ODD + [(30, again), (30, again + " fourteen"), (31, "zero " + again), (None, again), (29, again.replace("one", "One")), (7, "x" * 199_999 + "y " + again)]
    assert removal(phrases.remove_repeats(table(spark, rows))) == sorted(removed_by_hand(rows), key=key)
    assert removal(phrases.remove_repeats(table(spark, []))) == []


def test_periodic_texts_in_several_passages(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LONGEST", 8)
    rows = [(1, "a b " * 60), (2, "b a " * 40 + "c"), (3, "c " + "a b " * 30), (4, "a " * 90), (5, "a " * 50)]
    for common in (65_536, 10):
        assert removal(phrases.remove_repeats(table(spark, rows), common=common)) == sorted(removed_by_hand(rows), key=key)


def test_anchors_of_other_sizes(spark):
    rows = passages(5, 120)
    for window, anchor in ((5, 5), (6, 1), (20, 8)):
        assert removal(phrases.remove_repeats(table(spark, rows), window, anchor)) == sorted(removed_by_hand(rows, window), key=key)


def test_equal_windows_have_equal_anchors():
    import pyarrow as pa

    from skyframe.llm.arrow import Block

    block = Block(pa.array([" ".join(f"w{i}" for i in range(200)), "zz " + "  ".join(f"w{i}" for i in range(90, 140))]))
    doc, first, last, value = phrases._anchors(block, 13, 5)
    of = {}
    for d, a, b, v in zip(doc, first, last, value, strict=True):
        for w in range(a, b + 1):
            words = tuple(block.data[block.word_starts[x] : block.word_ends[x]].tobytes() for x in range(w, w + 13))
            assert of.setdefault(words, v) == v
    assert len(of) == 188 + 1 and len(set(value.tolist())) < 60


def test_automaton_symbols_are_words():
    automaton = phrases.PhraseAutomaton(2)
    text = automaton.encode([f"w{i}" for i in range(60_000)])
    assert len(set(text)) == 60_000 and not any(0xD800 <= ord(c) < 0xE000 for c in text)
    automaton.compile({text[55_295:55_297]: 5})
    assert automaton.locate(text) == [(55_295, 55_297, 5)]


def middle_by_hand(rows):
    out = []
    for i, text in rows:
        text = text or ""
        tokens = TOKEN.findall(text)
        n = len(tokens)
        sha = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(sha[k : k + 8], 16) for k in (0, 8, 16, 24))
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
            out.append((i, n, "plain", None, None, text, text))
        elif h4 % 100 < 80:
            out.append((i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text))
        else:
            out.append((i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text))
    return sorted(out, key=key)


def middle(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")) for r in fill_in_middle.restore(df).collect()), key=key)


def test_middle_against_brute_force(spark):
    rng = random.Random(1)
    rows = ODD + [(100 + i, "".join(rng.choice(["a", "é", "漢", "😀", " ", "\n", "<", "S>", "word"]) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    want = middle_by_hand(rows)
    assert middle(fill_in_middle.transform(table(spark, rows))) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    assert middle(fill_in_middle.transform(table(spark, []))) == []


def test_middle_at_characters(spark):
    rows = [(i, "aé漢😀b" * 5) for i in range(60)]
    for r in fill_in_middle.restore(fill_in_middle.transform(table(spark, rows), rate=100, unit="chars")).collect():
        h = fill_in_middle.draws(42, r["doc_id"])
        a, b = sorted((h[0] % 26, h[1] % 26))
        assert (r["n"], r["prefix_chars"], r["middle_chars"], r["restored"]) == (25, a, b - a, "aé漢😀b" * 5)


def test_exception_index_both_ways():
    text = "aé漢😀b" * 20 + "plain ascii " * 20 + "ÿ"
    index = fill_in_middle.ExceptionIndex(np.frombuffer(text.encode(), np.uint8))
    points = np.arange(len(text) + 1)
    at = np.array([len(text[:i].encode()) for i in points])
    assert (index.to_bytes(points) == at).all() and (index.to_points(at) == points).all()
    assert len(index.bytes) == 61


@pytest.mark.parametrize("name", ["op12_substring_dedup", "op13_fill_in_middle"])
def test_query_columns(spark, name):
    want = {"op12_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
            "op13_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]}[name]
    df = entry_point.queries()[name](spark, SF)
    assert df.columns == want and df.count() == 200


def test_digests_of_the_middle(spark):
    rows = [(i, t) for i, t in ODD]
    got = {(r["doc_id"], r["n"]): (r["output_sha256"], r["restored_sha256"]) for r in fill_in_middle.digests(fill_in_middle.transform(table(spark, rows))).collect()}
    for i, n, *_, output, text in middle_by_hand(rows):
        assert got[i, n] == (hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
