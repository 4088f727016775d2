"""Named JSON documents beside a table."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from lamina.sources.table import Table


class Meta:
    """One document."""

    def __init__(self, table: Table, name: str):
        self._table, self.name = table, name

    def read(self) -> object:
        return self._table.files.read_json(f"meta/{self.name}.json")

    def write(self, value: object) -> None:
        self._table.check_writable("write metadata")
        self._table.files.write_json(f"meta/{self.name}.json", value)

    def update(self, value: dict) -> None:
        """Merge keys at the top level."""
        self._table.check_writable("update metadata")
        self.write({**self.read(), **value})

    def __repr__(self) -> str:
        return f"Meta({self.name!r})"


class MetaSet(Mapping):
    """The documents of a table by name; assignment goes through create_meta and write."""

    def __init__(self, table: Table):
        self._table = table

    def __iter__(self) -> Iterator[str]:
        return iter(n[: -len(".json")] for n in self._table.files.names("meta") if n.endswith(".json"))

    def __len__(self) -> int:
        return len(list(iter(self)))

    def __contains__(self, name: object) -> bool:
        return name in set(self)

    def __getitem__(self, name: str) -> Meta:
        if name not in self:
            raise RuntimeError(f"no metadata {name!r}")
        return Meta(self._table, name)

    def __setitem__(self, name: str, value: object) -> None:
        raise TypeError("use create_meta, and write of the document")

    def __repr__(self) -> str:
        return f"MetaSet({list(self)})"
