"""External transforms: programs that derive one file from another, run one file to a task."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import time
from dataclasses import dataclass, field

from weftline.sources.folders import file_digest

TAIL = 2000


class ToolError(RuntimeError):
    """A tool isn't there, or can't be run."""


@dataclass(frozen=True)
class Run:
    returncode: int
    seconds: float
    argv: list[str]
    tail: str


def run_command(argv: list[str], cwd: str | None = None, timeout: float | None = None) -> Run:
    began = time.monotonic()
    try:
        done = subprocess.run(argv, cwd=cwd, timeout=timeout, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, check=False)
        code, said = done.returncode, done.stdout
    except subprocess.TimeoutExpired as e:
        code, said = -1, (e.stdout or b"") + f"\nstopped after {timeout} s".encode()
    except OSError as e:
        raise ToolError(f"{argv[0]}: {e}") from e
    return Run(code, time.monotonic() - began, argv, said.decode("utf-8", "replace")[-TAIL:])


def located(explicit: str | None, name: str) -> str:
    path = shutil.which(explicit or name) or (explicit if explicit and os.path.isfile(explicit) else None)
    if not path:
        raise ToolError(f"{explicit or name} not found")
    return os.path.abspath(path)


@dataclass(frozen=True)
class Quantizer:
    """A quantising program: options, source, output, type. Its bytes identify the build."""

    binary: str
    sha256: str
    version: str

    @classmethod
    def locate(cls, explicit: str | None = None) -> Quantizer:
        binary = located(explicit, "llama-quantize")
        try:
            said = run_command([binary, "--help"], timeout=30).tail
        except ToolError:
            said = ""
        banner = re.search(r"build\s*[:=]\s*(\S+(?: \(\w+\))?)", said)
        return cls(binary, file_digest(binary), banner[1] if banner else "")

    def argv(self, source: str, out: str, qtype: str, imatrix: str | None, embedding: str | None, output: str | None) -> list[str]:
        options = [("--imatrix", imatrix), ("--token-embedding-type", embedding), ("--output-tensor-type", output)]
        return [self.binary, *(x for flag, value in options if value for x in (flag, value)), source, out, qtype]

    def run(self, source, out, qtype, imatrix=None, embedding=None, output=None, cwd=None, timeout=None) -> Run:
        """imatrix is passed as given: its string becomes part of the output's header."""
        return run_command(self.argv(source, out, qtype, imatrix, embedding, output), cwd, timeout)


@dataclass(frozen=True)
class Converter:
    """A converting script: a snapshot folder to a tensor file. The folder's name is an input."""

    script: str
    python: str
    sha256: str
    git_ref: str = ""
    python_version: str = ""
    key_libraries: dict = field(default_factory=dict)

    @classmethod
    def locate(cls, folder: str | None = None, script: str | None = None, python: str | None = None, git_ref: str | None = None) -> Converter:
        path = script or (os.path.join(folder, "convert_hf_to_gguf.py") if folder else "")
        if not os.path.isfile(path):
            raise ToolError(f"converter script not found: {path or 'none given'}")
        python = located(python, "python3")

        def said(argv: list[str], seconds: float) -> str:
            try:
                run = run_command(argv, timeout=seconds)
            except ToolError:
                return ""
            return run.tail.strip() if run.returncode == 0 else ""

        ref = git_ref or said(["git", "-C", os.path.dirname(os.path.abspath(path)), "rev-parse", "HEAD"], 15)
        version = said([python, "-c", "import platform; print(platform.python_version())"], 30)
        probe = "import importlib.metadata as m\nfor n in ('torch','transformers','numpy','safetensors','gguf','sentencepiece'):\n  try: print(n, m.version(n))\n  except Exception: pass"
        libraries = dict(line.split(" ", 1) for line in said([python, "-c", probe], 60).splitlines() if " " in line)
        return cls(os.path.abspath(path), python, file_digest(path), ref, version, libraries)

    def run(self, snapshot: str, out: str, outtype: str = "f16", model_name: str | None = None, timeout: float | None = None) -> Run:
        named = ["--model-name", model_name] if model_name else []
        return run_command([self.python, self.script, "--outtype", outtype, *named, "--outfile", out, snapshot], timeout=timeout)
