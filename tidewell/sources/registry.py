"""Schemas by subject, with ids, in a folder."""

from __future__ import annotations

import json
import logging
import os
from pathlib import Path
from typing import Any

from tidewell.functions.types import canonical

log = logging.getLogger(__name__)


class Registry:
    """A file-backed schema registry: one file a schema, named by its id; a subject keeps the ids it was given."""

    def __init__(self, folder: str | Path):
        text = str(folder).removeprefix("file://")
        if "://" in text:
            raise ValueError(f"the registry's folder must be one that the driver can open, not {folder}")
        self.folder = Path(text)
        self.folder.mkdir(parents=True, exist_ok=True)

    def _all(self) -> dict[int, dict[str, Any]]:
        return {int(p.stem): json.loads(p.read_text()) for p in sorted(self.folder.glob("*.json"))}

    def latest(self, subject: str) -> tuple[int, str] | None:
        own = [(i, v["schema"]) for i, v in self._all().items() if v["subject"] == subject]
        return max(own) if own else None

    def schemas(self) -> dict[int, str]:
        """Every schema by its id."""
        return {i: v["schema"] for i, v in self._all().items()}

    def by_id(self, schema_id: int) -> str:
        return json.loads((self.folder / f"{schema_id}.json").read_text())["schema"]

    def create_if_absent(self, subject: str, schema: str) -> int:
        """The id of the subject's schema: a new one if it has none, else that which it has, with a warning where it differs."""
        if known := self.latest(subject):
            if canonical(known[1]) != canonical(schema):
                log.warning("%s keeps its schema %d, which differs", subject, known[0])
            return known[0]
        number = max(self._all(), default=0) + 1
        while True:  # a file is created by one writer alone
            try:
                fd = os.open(self.folder / f"{number}.json", os.O_WRONLY | os.O_CREAT | os.O_EXCL)
                break
            except FileExistsError:
                number += 1
        with os.fdopen(fd, "w") as f:
            json.dump({"subject": subject, "schema": schema}, f)
        return number
