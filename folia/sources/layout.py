"""Folder layout of a working tree: years, corpora and databases as plain paths; nothing is created unless asked for."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Layout:
    root: str
    databases: tuple[str, ...] = ("scopus", "wos")
    stages: tuple[str, ...] = ("rawdata", "parsing")
    merged: tuple[str, ...] = ("concat", "dedup")
    names: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_json(cls, file: str) -> Layout:
        """A layout from a file with the fields of this class; names that it lacks keep their defaults."""
        with open(file, encoding="utf-8") as f:
            given = json.load(f)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in cls.__dataclass_fields__})

    def path(self, year: str, database: str, stage: str) -> str:
        return "/".join([self.root.rstrip("/"), year, "Corpus", self.names.get(database, database), self.names.get(stage, stage)])

    def paths(self, year: str) -> dict[tuple[str, str], str]:
        """(database or merged stage, stage): folder."""
        out = {(d, s): self.path(year, d, s) for d in self.databases for s in self.stages}
        return out | {(m, "parsing"): self.path(year, m, "parsing") for m in self.merged}

    def create(self, year: str) -> None:
        for p in self.paths(year).values():
            Path(p).mkdir(parents=True, exist_ok=True)
