"""The operators against brute force, libraries and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline
from skyframe.llm import bpe, exact_dedup, html_text, licences, near_dedup, packing, quality_rules, token_output, toxicity, weak_quality
from skyframe.llm.queries import held_out

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = re.compile(r"[\x20\x09-\x0D]")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[BLANKS.sub("", t)].append((-len(t), i))
    return {i: (min(g)[1], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g}


def test_exact_groups(spark, docs, texts):
    for rows, parts in ((list(texts.items()), 3), ([(i, f"t {i % 7}" + " " * (i % 3)) for i in range(3000)], 40)):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        got = exact_dedup.exact_groups(df).collect()
        want = exact_by_hand(rows)
        assert len(got) == len(rows)
        for r in got:
            assert (r["keep_id"], r["group_size"], r["text_sha256"]) == want[r["doc_id"]]
            assert r["kept"] == (r["keep_id"] == r["doc_id"])


def test_a_guard_separates_equal_digests():
    import pyarrow as pa

    rows = {"run": [0, 0, 0], "digest": [b"d" * 32] * 3, "norm_len": [4, 4, 5], "guard": [1, 1, 1], "n_points": [9, 4, 5], "best_id": [7, 3, 1], "home": [0, 1, 0], "n": [2, 1, 1]}
    batch = pa.RecordBatch.from_pydict(rows, pa.schema([("run", pa.int32()), ("digest", pa.binary()), ("norm_len", pa.int32()), ("guard", pa.int64()), ("n_points", pa.int32()),
                                                        ("best_id", pa.int64()), ("home", pa.int32()), ("n", pa.int64())]))
    out = [r for b in exact_dedup._merge(iter([batch.slice(0, 1), batch.slice(1, 2)])) for r in b.to_pylist()]
    assert [(r["best_id"], r["n"]) for r in out] == [(7, 3), (1, 1)]


def near_by_hand(texts, k):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_groups(spark, texts):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = dict(texts)
    for i in range(150):  # a large group around one text, and texts with few words
        words = list(base)
        for j in rng.sample(range(120), rng.randint(0, 5)):
            words[j] = f"x{rng.random()}"
        rows[1000 + i] = " ".join(words)
    rows |= {2000: "one two", 2001: "One  TWO", 2002: "one", 2003: "", 2004: " \n", 2005: "two one"}
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string").repartition(5)
    for k in (4, 5):
        want = near_by_hand(rows, k)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(df, k).collect()}
        assert got == want


def test_large_regions_are_divided(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "DIVIDE", 160)
    rows = [(i, " ".join(f"w{j}" for j in range(60)) + f" end{i % 400}") for i in range(500)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_large_regions_lose_no_pair(spark):
    rng = random.Random(7)
    # one long passage with an ending of its own (similarity 0.75), and planted pairs that share some of their endings (0.83)
    passage, texts = " ".join(f"t{i}" for i in range(103)), []
    for i in range(1000):
        own = [f"o{rng.random()}" for _ in range(17)]
        texts.append(" ".join([passage, *own]))
        if i < 200:
            texts.append(" ".join([passage, *own[:6], *(f"p{rng.random()}" for _ in range(11))]))
    rng.shuffle(texts)
    sets = [{tuple(w[j : j + 4]) for j in range(len(w) - 3)} for w in (t.split() for t in texts)]
    column = {s: c for c, s in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(column)), np.float32)
    for i, s in enumerate(sets):
        held[i, [column[x] for x in s]] = 1
    common, size = held @ held.T, held.sum(axis=1)
    want = list(range(len(texts)))
    for a, b in np.argwhere(np.triu(100 * common >= 80 * (size[:, None] + size - common), 1)):
        want[b] = want[a]
    got = near_dedup.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5), 4).collect()
    assert len(set(want)) == 1000
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))


HTML = [
    ("<p>One<p>Two <b>bold</b><br>line", "One\n\nTwo bold\nline"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>end", "- a\n- b\n  3. c\n  4. d\n\nend"),
    ("<table><caption>T</caption><tr><th>name<th>n<tr><td>long name<td>1<tr><td>x<td>22</table>", "T\nname       n\nlong name  1\nx          22"),
    ("<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>", "a        b\n\nin  ner"),
    ("<style>p{}</style><script>1<2</script><div hidden>no</div><div style='display: none'>no</div><p>yes&amp;&copy;", "yes&©"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    ("<details><summary>S</summary>closed</details><details open><summary>S</summary>open</details>", "S\nS\nopen"),
    ("a <!-- x --> b\n\n c", "a b c"),
    ("<head><title>t</title><body>x", "x"),
    ("<dl><dt>k<dd>v</dl>", "k\n  v"),
    ("<a href='x>y'>z</a> 1 < 2", "z 1 < 2"),
    ("<table><tr><form><td>x</td><td>y</td></form></tr></table>", "x  y"),
    ("<table><form><tr><td>x</td></tr></form><tr><td>y</table>", "x\ny"),
    ("<table>text<tr><td>x</table>", "text\nx"),
    ("<table><div>text</div><tr><td>x</table>", "text\nx"),
    ("<table><tr><p>text</p></tr></table>", "text"),
    ("<table><tbody>a <b>b</b><tr><td>x</tbody></table>", "a b\nx"),
    ("<table><tr>a<td>x<td>y</table>", "a\nx  y"),
    ("<table><table><tr><td>in</table><tr><td>x</table>", "in\nx"),
    ("<table>a<tr>b<td>x</table>", "a b\nx"),
    ("<table>" + "<b>" * 20_000 + "<tr><td>x</table>", "x"),
    ("<table><details><tr><td>no</td></tr></details><tr><td>x</table>", "x"),
    ("<table><tr><div hidden>no</div><td>x</table>", "x"),
]


@pytest.mark.parametrize("html,text", HTML)
def test_html(html, text):
    assert html_text.visible_text(html) == text


def test_pages_lose_no_visible_word(spark):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.off, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("title", "style", "script")
            self.out.append(" " if tag not in ("b", "a", "span") else "")

        def handle_endtag(self, tag):
            self.off -= tag in ("title", "style", "script")
            self.out.append(" " if tag not in ("b", "a", "span") else "")

        def handle_data(self, data):
            if not self.off:
                self.out.append(data)

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_text.extract_pages(pages).collect():
        p = Plain()
        p.feed(raw[r["page_id"]])
        p.close()
        got = [w for line in r["text"].split("\n") for w in re.sub(r"^- ", "", line).split()]
        assert got == "".join(p.out).split()


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(1)
    m = len(weak_quality.LABELLERS)
    good = rng.random(20_000) < 0.8
    right = np.linspace(0.7, 0.95, m)
    vote = np.where(rng.random((20_000, m)) < right, good[:, None], ~good[:, None]).astype(np.int8)
    vote[rng.random(vote.shape) < 0.3] = -1
    patterns, count = np.unique(vote, axis=0, return_counts=True)
    model = weak_quality.estimate(patterns, count)
    assert abs(model.prior - 0.8) < 0.03
    cast = model.on_good[:, 1] / model.on_good.sum(axis=1)
    assert np.abs(cast - right).max() < 0.05


def test_quality_classifier_agrees_with_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = weak_quality.classify(d, weak_quality.fit(d, max_rows=800)).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    wrong = Counter((r["quality"], r["kept"]) for r in got)
    assert wrong[1, False] <= 0.02 * (wrong[1, True] + wrong[1, False])
    assert wrong[0, True] <= 0.15 * (wrong[0, True] + wrong[0, False])


def check_pieces(pieces, rows, seq_len):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in rows.items():
        ids = tok.encode(text, add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= seq_len
        padding += 0 if at & (at - 1) == 0 else seq_len - at
    return padding


def test_packing(spark, docs, texts):
    got = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()
    assert check_pieces(got, texts, packing.SEQ_LEN) == 0


def test_packing_evens_costs():
    lengths = np.random.default_rng(2).integers(1, 1024, 3000)
    placed = packing.pack(lengths)
    spent, fill = Counter(), Counter()
    for _, _, n, s, _ in placed:
        spent[s] += packing.cost(n)
        fill[s] += n
    first_fit = [[1024, 0] for _ in range(lengths.sum() // 1024)]
    for n in sorted(map(int, lengths), reverse=True):  # the fullest sequence instead of the cheapest
        best = min((x for x in first_fit if x[0] >= n), key=lambda x: x[0], default=None)
        for x in [best] if best else first_fit:
            take = min(n, x[0])
            x[0], x[1], n = x[0] - take, x[1] + packing.cost(take), n - take
    full = [spent[s] for s in fill if fill[s] == 1024]
    assert np.std(full) < np.std([c for _, c in first_fit])
    assert sum(fill.values()) == lengths.sum()


def base_by_hand(text):
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_quality_rules(spark, docs, texts):
    rows = dict(texts) | {5000: "a b c d e f a b c d e f", 5001: "x\nx\n\n\n x\ny\nx", 5002: "é ü" * 9, 5003: "", 5004: "a b c\x0bd"}
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_rules.apply_rules(df, quality_rules.fit(docs, labels)).collect()
    for r in got:
        want = base_by_hand(rows[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["probability"] >= quality_rules.KEEP_AT)


def test_quality_rules_on_held_out_labels(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.fit(d, l.filter("doc_id % 2 = 0"), max_rows=1000)
    got = quality_rules.apply_rules(d, model).join(l.filter("doc_id % 2 = 1"), "doc_id").collect()
    n = Counter((r["quality"], r["kept"] or r["base_failed"]) for r in got)
    assert n[1, False] <= 0.01 * n[1, True]
    assert sum(r["quality"] == 0 and r["kept"] for r in got) <= 0.05 * sum(r["quality"] == 0 for r in got)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = ["idiot", "moron", "disgusting", "scum", "worthless"]
    lexicon = toxicity.Lexicon([toxicity.Term(t, False, 1.0, 2 if len(t) >= 9 else 1 if len(t) >= 5 else 0) for t in terms])
    rng = random.Random(5)
    for _ in range(4000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(1, len(word))
            op = rng.randint(0, 2)
            word[i : i + (op != 0)] = rng.choice("abcdeilmnorstu") if op != 2 else ""
        word = "".join(word)
        want = 0
        for t in terms:
            d = distance(word[1:], t[1:]) if word[0] == t[0] else 99
            want = max(want, 2 if d == 0 else 1 if d <= (2 if len(t) >= 9 else 1 if len(t) >= 5 else 0) else 0)
        assert {0: 0, 2: 1, 1: 2}[want] == lexicon.match(word)[1], word


def test_context_tells_quotation_from_abuse():
    memo = toxicity._Memo(toxicity.Lexicon([toxicity.Term("idiot", False, 5.0, 1)]))
    weight = lambda t: sum(toxicity.features(t, memo)[:3])
    assert weight('he said the word "idiot" in his report') < weight("what an idiot that man there is")
    assert weight("you are an idiot and that is so") > weight("what an idiot that man there is")
    assert toxicity.Lexicon([toxicity.Term("idiot", False, 5.0, 1)]).match("1d10t!!")[1] == 2


def test_toxicity_on_held_out_labels(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(d, l, rule=lambda c: ~held_out(c))
    got = toxicity.score(d, model).filter(held_out("doc_id")).join(l, "doc_id").collect()
    n = Counter((r["toxic"], r["predicted"]) for r in got)
    assert n[1, 1] >= 0.85 * (n[1, 1] + n[1, 0])
    assert n[0, 1] <= 0.01 * (n[0, 1] + n[0, 0])


def test_bpe_equals_the_library(spark, texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    vocab = bpe.vocabulary(path, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    rows = dict(texts) | {9000: "a" * 3000, 9001: "ab" * 2000, 9002: " \n\n  x", 9003: "日本語 👩‍👩‍👧 <|endoftext|>", 9004: ""}
    got = bpe.encode_documents(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string"), path, public_tokenizers.PATTERN).collect()
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode_ordinary(rows[r["doc_id"]])
        assert r["decoded"] == rows[r["doc_id"]].encode()


def test_perfect_hash_is_minimal():
    vocab = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    slots = vocab.hash.slots(bpe.hash_strings(vocab.tokens))
    assert sorted(slots.tolist()) == list(range(len(vocab.tokens)))
    assert all(vocab.tokens[vocab.at[s]] == t for s, t in zip(slots, vocab.tokens, strict=True))


def test_licences_are_found_whole(spark):
    filler = " ".join(f"word{i}" for i in range(90))
    rows = [(i, f"{filler[: 37 * i]} {text} {filler}") for i, text in enumerate(licences.TEMPLATES.values())]
    rows += [(100, filler), (101, "Licensed under the"), (102, "LICENSED under\nthe apache---license version 2 0")]
    got = {(r["doc_id"], r["licence"]): r["containment"] for r in licences.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = {(i, k): 1.0 for i, k in enumerate(licences.TEMPLATES)} | {(102, "apache-2.0"): 1.0}
    assert got == want


def test_short_notices_are_found(spark):
    rows = [(0, "a b c d e f g All rights\nRESERVED. x"), (1, "all rights reserved"), (2, "all rights"), (3, "a b c all rights reserved"), (4, None), (5, "Copyright Licensed under CC BY-NC 4.0.")]
    wanted = licences.TEMPLATES | licences.SHORT_NOTICES | {"one": "Copyright"}
    got = {(r["doc_id"], r["licence"]): (r["n_windows"], r["first_word"], r["containment"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), wanted).collect()}
    name = "all-rights-reserved"
    assert got == {(0, name): (1, 6, 1.0), (1, name): (1, 0, 1.0), (3, name): (2, 0, 1.0), (5, "one"): (1, 0, 1.0), (5, "cc-by-nc-4.0"): (1, 0, 1.0)}
    with pytest.raises(ValueError):
        licences.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), {"none": " ."})


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 1000, 4097):
        out = token_output.permute(np.arange(n), n, 42)
        assert sorted(out.tolist()) == list(range(n))
    assert (token_output.permute(np.arange(1000), 1000, 1) != token_output.permute(np.arange(1000), 1000, 2)).any()
    assert token_output.permute(np.array([7]), 1000, 1)[0] == token_output.permute(np.arange(1000), 1000, 1)[7]


def test_shards_read_back(spark, docs, texts, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = f"file://{tmp_path}/shards"
    rows = token_output.write_shards(docs, folder, path, public_tokenizers.PATTERN, key=9, seq_len=128, shard_size=100).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    records = list(token_output.read_records(folder, 0, len(rows), 128, 100))
    enc = packing.encoding(path, public_tokenizers.PATTERN)
    whole = defaultdict(dict)
    for r in rows:
        assert zlib.crc32(records[r["slot"]].tobytes()) == r["ids_crc32"]
        whole[r["doc_id"]][r["start"]] = records[r["slot"]][: r["length"]].tolist()
    for i, text in texts.items():
        ids = [x for s in sorted(whole[i]) for x in whole[i][s]]
        assert ids[-1] == 0 and enc.decode(ids[:-1]) == text
    later = list(token_output.read_records(folder, 137, 90, 128, 100))
    assert all((a == b).all() for a, b in zip(later, records[137:227], strict=True))


def test_pipeline_keeps_what_its_stages_keep(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, left = {r["doc_id"]: r["text"] for r in left.collect()}, stage(spark, left, SF).cache()
        after = {r["doc_id"]: r["text"] for r in left.collect()}
        assert after.items() <= before.items()
        if name == "exact_dedup":
            assert set(after) == {k for k, _, _ in exact_by_hand(before.items()).values()}
        if name == "near_dedup":
            assert set(after) == {root for _, root in near_by_hand(before, 5).values()}
    kept = {r["doc_id"]: r["text"] for r in left.collect()}
    assert check_pieces(entry_point.queries()["pipeline"](spark, SF).collect(), kept, packing.SEQ_LEN) == 0


def test_hashes_of_long_words_have_no_period():
    import pyarrow as pa

    from skyframe.llm.arrow import Block

    words = ["".join("b" if i == at else "a" for i in range(140_000)) for at in (0, 65_536, 131_072, 3)]
    assert len(set(Block(pa.array(words)).word_hashes().tolist())) == 4


def test_near_groups_of_long_words(spark):
    words = ["".join("b" if i == at else "a" for i in range(70_000)) for at in (0, 65_536)]
    got = near_dedup.near_groups(spark.createDataFrame(list(enumerate(words)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 1}


def test_long_lines_are_compared_whole(spark):
    lines = ["".join("b" if i == at else "a" for i in range(70_000)) for at in (0, 65_536)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join([lines[0]] * 2))], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["n_dup_lines"] for r in quality_rules.apply_rules(df, quality_rules.fit(df, labels)).collect()}
    assert got == {1: 0, 2: 1}


def test_two_texts_under_one_id(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:59], "x"])
    rows = [(1, " ".join(base)), (4, near), (4, "quite another text that has nothing in common with the rest"), (4, near), (9, "quite another text that has nothing in common with the rest")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(df).collect())
    assert got == Counter([(1, 56, 1, True), (4, 56, 1, False), (4, 56, 1, False), (4, 7, 4, True), (9, 7, 4, False)])
    kept = Counter((r["doc_id"], r["text"]) for r in near_dedup.keep_one_of_each(df).collect())
    assert kept == Counter([rows[0], rows[2]])


def test_ties_of_near_copies(spark):
    words = [f"w{i}" for i in range(84)]
    rows = [(7, " ".join(words)), (3, " ".join(words)), (5, " ".join([*words[:-9], *(f"y{i}" for i in range(9))]))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: c for i, (_, c) in near_by_hand(dict(rows), 5).items()}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)], [(500 - i, 500) for i in range(1, 300)],
                                   [(i, 2 * i) for i in range(1, 100)] + [(3, 3), (8, 4)], []])
def test_components_of_links(spark, edges):
    from skyframe.llm import graph

    rng = random.Random(4)
    rng.shuffle(edges)
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = graph.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for x in root if find(x) != x}
    assert len(got) == len({r["node"] for r in got})
