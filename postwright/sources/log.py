"""Structured log, timer and seed."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
from pyarrow import fs


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and a path in it, of a URI or a local path."""
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


class Log:
    """Events as JSON lines, each with its name and the seconds since the log began; written whole by ``close``. Spark reads them as a table."""

    def __init__(self, uri: str):
        self.uri, self.began, self.lines = uri, time.monotonic(), []

    def event(self, name: str, **values: Any) -> None:
        self.lines.append(json.dumps({"event": name, "at": round(time.monotonic() - self.began, 6), **values}, default=str, sort_keys=True))

    @contextmanager
    def timed(self, name: str, **values: Any) -> Iterator[None]:
        """Logs how long the block took, also where it fails."""
        began, failed = time.monotonic(), None
        try:
            yield
        except BaseException as e:
            failed = repr(e)
            raise
        finally:
            self.event(name, seconds=round(time.monotonic() - began, 6), failed=failed, **values)

    def close(self) -> None:
        files, path = open_uri(self.uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        with files.open_output_stream(path) as out:
            out.write("".join(f"{x}\n" for x in self.lines).encode())


def seeded(seed: int) -> np.random.Generator:
    """Python's and numpy's generators set to a seed, and a generator of its own with the same."""
    random.seed(seed)
    np.random.seed(seed % (1 << 32))
    return np.random.default_rng(seed)
