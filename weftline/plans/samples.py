"""Folders of small tensor files that derive from one another, to run the engine's plans from end to end."""

from __future__ import annotations

import os
import stat
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from weftline.plans import sample_tool
from weftline.workers import reachable

SCRIPT = os.path.abspath(sample_tool.__file__)


def write_tool(path: str, note: str = "") -> str:
    """A program that quantises as sample_tool does; another note makes it another build."""
    with open(path, "w") as file:
        file.write(f'#!/bin/sh\n# {note}\nexec "{sys.executable}" -SE "{SCRIPT}" "$@"\n')
    os.chmod(path, os.stat(path).st_mode | stat.S_IXUSR)
    return path


def flip(path: str, back: int) -> None:
    """Changes the byte so far from the end."""
    with open(path, "r+b") as file:
        file.seek(-back, os.SEEK_END)
        old = file.read(1)[0]
        file.seek(-back, os.SEEK_END)
        file.write(bytes([old ^ 0xFF]))


def write_ladder(folder: str, name: str, embd: int = 32, vocab: int = 64) -> None:
    """A source, two files that derive from it (one by a variant's overrides), one that nearly does, and one that is no tensor file."""
    at = lambda kind: os.path.join(folder, f"{name}-{kind}.gguf")
    source = sample_tool.model(at("f16"), name, name, embd, vocab)
    sample_tool.derive(source, at("Q8_0"), "Q8_0")
    sample_tool.derive(source, at("Q4_K_L"), "Q4_K_M", embedding="q8_0")
    sample_tool.derive(source, at("Q6_K"), "Q6_K")
    flip(at("Q6_K"), 5)
    with open(at("odd"), "wb") as file:
        file.write(name.encode() * 64)


def write_ladders(names: DataFrame, folder: str, embd: int = 32, vocab: int = 64) -> int:
    """A ladder for each row of names (name), one task each, in a folder that all tasks share; how many."""
    os.makedirs(folder, exist_ok=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["name"]:
                write_ladder(folder, name, embd, vocab)
            yield frame

    reachable(names.sparkSession)
    return names.repartition(max(1, names.count()), "name").mapInPandas(run, "name string").count()
