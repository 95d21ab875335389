"""Command line: 0 is success, 1 a usage or environment error, 2 a refusal; exec returns its child's code."""

from __future__ import annotations

import argparse
import os
import subprocess
import sys

from pyspark.sql import SparkSession

from weftline.operators.bytes import BlobError
from weftline.operators.transform import Converter, ToolError
from weftline.plans import cache, packer, prune, rebuild, statements
from weftline.sources.manifest import AmbiguousName, Manifest, ManifestError

REFUSALS = (BlobError, rebuild.RebuildError, ManifestError, prune.PruneRefused, statements.InvalidStatement, statements.VerifyFailed, statements.StatementError)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftline", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str, **options) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for n in names:
            p.add_argument(n)
        for flag, kind in options.items():
            flag = "-o" if flag == "o" else "--" + flag.replace("_", "-")
            p.add_argument(flag, action="store_true") if kind is bool else p.add_argument(flag, action="append") if kind is list else p.add_argument(flag, type=kind)
        return p

    command("pack", "folder", o=str, llama_quantize=str, prune=bool, keep=list)
    command("unpack", "pack", "name", o=str, llama_quantize=str)
    command("get", "pack", "name", llama_quantize=str)
    command("exec", "pack", "name", llama_quantize=str).add_argument("child", nargs=argparse.REMAINDER)
    command("cache", "what", pack=str, max_size=str)
    command("attest", "quant", source=str, imatrix=str, qtype=str, token_embedding_type=str, output_tensor_type=str, llama_quantize=str, llama_cpp_ref=str, deterministic_build=bool, source_uri=str, source_download_url=str, o=str)
    command("verify-attestation", "statement", dir=str, llama_quantize=str, check_source=bool, timeout=float)
    tools = {"llama_cpp_dir": str, "converter": str, "python": str, "timeout": float}
    command("attest-conversion", "output", source_dir=str, llama_cpp_ref=str, model_name=str, source_uri=str, source_revision=str, o=str, **tools)
    command("verify-conversion", "statement", dir=str, check_source=bool, **tools)
    command("verify-chain", "quant_statement", "conversion_statement", dir=str, llama_quantize=str, check_source=bool, **tools)
    command("stats", "pack")
    command("verify", "pack", llama_quantize=str)
    return top


def child_argv(words: list[str], path: str) -> list[str]:
    words = words[1:] if words[:1] == ["--"] else words
    return [w.replace("{}", path) for w in words] if any("{}" in w for w in words) else [*words, path]


def table(rows: list[tuple[str, ...]], heads: tuple[str, ...], right: str) -> str:
    """Lines of columns as wide as what they hold; right has a > for each column that is set flush right."""
    lines = [heads, *rows]
    wide = [max(len(line[i]) for line in lines) for i in range(len(heads))]
    lines.insert(1, tuple("-" * w for w in wide))
    return "\n".join("  ".join(f"{cell:{side}{w}}" for cell, side, w in zip(line, right, wide, strict=True)).rstrip() for line in lines)


def _run(a: argparse.Namespace, spark: SparkSession) -> int:
    say = lambda *x: print(*x, file=sys.stderr)
    converter = lambda: Converter.locate(a.llama_cpp_dir, a.converter, a.python, getattr(a, "llama_cpp_ref", None))
    if a.command == "pack":
        if a.keep and not a.prune:
            raise ValueError("--keep needs --prune")
        out = a.o or a.folder.rstrip("/") + ".pack"
        manifest = packer.pack(spark, a.folder, out, a.llama_quantize, log=say)
        if a.prune:
            for r in prune.prune(spark, a.folder, out, manifest, a.keep).collect():
                say(f"{r.filename}: {r.action} {r.reason or ''}".rstrip())
    elif a.command in ("unpack", "get", "exec"):
        if a.command == "exec" and a.child in ([], ["--"]):
            raise ValueError("exec needs a command, as in: exec PACK NAME -- COMMAND {}")
        if a.command == "unpack":
            manifest = Manifest.load(a.pack)
            entry = manifest.find(spark, a.name)
            if entry is None:
                raise LookupError(f"nothing in the pack is called {a.name!r}")
            if note := rebuild.rebuild(a.pack, manifest, entry, a.o or entry.filename, a.llama_quantize):
                say(note)
            return 0
        path = cache.get(spark, a.pack, a.name, a.llama_quantize)
        if a.command == "get":
            print(path)
            return 0
        code = subprocess.run(child_argv(a.child, path), check=False).returncode
        return 128 - code if code < 0 else code
    elif a.command == "cache":
        if a.what == "ls":
            print(table([(r.pack_id[:16], r.filename, str(r["size"]), r.pack_path) for r in cache.cached(spark).collect()], ("PACK", "FILE", "SIZE", "FROM"), "<<><"))
        elif a.what == "clear":
            say(f"{cache.clear(spark, a.pack)} packs removed")
        elif a.what == "prune":
            most = cache.size_of(spark, a.max_size or "")
            if most is None:
                raise ValueError(f"not a size: {a.max_size!r}")
            for r in cache.evict(spark, most).collect():
                say(f"removed {r.path} ({r['size']})")
        else:
            raise ValueError(f"cache ls, clear or prune, not {a.what}")
    elif a.command == "attest":
        made = statements.attest(spark, a.quant, a.source, a.imatrix, a.llama_quantize, a.qtype, a.token_embedding_type, a.output_tensor_type, a.llama_cpp_ref, a.deterministic_build, a.source_uri, a.source_download_url, say)
        statements.save_statement(made, a.o or a.quant + ".derivation.json")
    elif a.command == "verify-attestation":
        say(statements.verify(spark, a.statement, a.llama_quantize, a.dir, a.timeout or statements.TIMEOUT, a.check_source, log=say) or "verified")
    elif a.command == "attest-conversion":
        made = statements.attest_conversion(spark, a.output, a.source_dir, converter(), a.model_name, True, a.source_uri, a.source_revision, a.timeout or statements.TIMEOUT, say)
        statements.save_statement(made, a.o or a.output + ".conversion.json")
    elif a.command == "verify-conversion":
        say(statements.verify_conversion(spark, a.statement, converter(), a.dir, a.timeout or statements.TIMEOUT, a.check_source, log=say) or "verified")
    elif a.command == "verify-chain":
        for note in statements.verify_chain(spark, a.quant_statement, a.conversion_statement, a.llama_quantize, converter(), a.dir, a.timeout or statements.TIMEOUT, a.check_source, log=say):
            say(note)
    elif a.command == "stats":
        rows = [(r.filename or r.plan, r.plan, r.recipe or "", r.size_text, r.stored_text, f"{r.ratio:.2f}x") for r in rebuild.stats(spark, a.pack).collect()]
        print(table(rows, ("FILE", "PLAN", "RECIPE", "SIZE", "STORED", "RATIO"), "<<<>>>"))
    elif a.command == "verify":
        rows = rebuild.verify(spark, a.pack, a.llama_quantize).orderBy("ord").collect()
        for r in rows:
            print(r.filename, r.status)
        ok = sum(r.status == "OK" for r in rows)
        say(f"{ok} of {len(rows)} files OK")
        return 0 if ok == len(rows) else 2
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 1
    try:
        return _run(args, spark or SparkSession.builder.config("spark.speculation", "false").getOrCreate())
    except REFUSALS as e:
        print(f"refused: {e}", file=sys.stderr)
        return 2
    except (ToolError, AmbiguousName, LookupError, ValueError, OSError, packer.PackError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    sys.exit(main())
