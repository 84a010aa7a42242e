"""Products of an analysis that are planned, and staged, when they are first asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame


class Products(Mapping):
    """Tables by name. A maker gets the products and may ask for others; each is made once."""

    def __init__(self, makers: dict[str, Callable[[Products], DataFrame]], shown: list[str]):
        self._makers, self._shown, self._made = makers, shown, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name](self)
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._shown)

    def __len__(self) -> int:
        return len(self._shown)

    @property
    def made(self) -> list[str]:
        """What has been asked for so far, stages included."""
        return list(self._made)
