"""Packing: for each derived file the cheapest plan that provably gives it back."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import asdict
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scalars import TYPE_CODES
from weftline.operators.bytes import LEVEL_FILE, LEVEL_PATCH, BlobError, BlobStore, Delta, patched, tail
from weftline.operators.transform import Quantizer, ToolError
from weftline.plans.identity import described, linked_matrices, linked_models
from weftline.sources.folders import file_digest, scan_folder
from weftline.sources.layouts import parse_layout, read_layouts
from weftline.sources.manifest import ENTRIES, Entry, Manifest
from weftline.workers import reachable

#: A delta above this share of the file is not worth its while.
CEILING = 0.5
OVERRIDABLE = {"token_embd.weight": "token_embedding_type", "output.weight": "output_tensor_type"}


class PackError(RuntimeError):
    """Packing can't go on."""


def type_map(layout: dict) -> dict[str, str]:
    return {t["name"]: TYPE_CODES.get(t["ggml_type"], f"UNKNOWN_{t['ggml_type']}") for t in layout["tensors"]}


def overrides(wanted: dict[str, str], got: dict[str, str]) -> dict[str, str] | None:
    """Types to override so that got becomes wanted: none if equal, None if that can't be done."""
    if wanted.keys() != got.keys():
        return None
    differing = {n: t for n, t in wanted.items() if got[n] != t}
    return differing if differing.keys() <= OVERRIDABLE.keys() else None


def congruent(a: dict, b: dict) -> bool:
    """The same tensors in the same places, so payload bytes correspond one to one."""
    return all(a[k] == b[k] for k in ("alignment", "data_size", "tensors"))


def cli_flags(recipe: dict) -> list[str]:
    pairs = [("--imatrix", "<IMATRIX>" if recipe["use_imatrix"] else None), ("--token-embedding-type", recipe["token_embedding_type"]), ("--output-tensor-type", recipe["output_tensor_type"])]
    return [x for flag, value in pairs if value for x in (flag, value)] + ["<SOURCE>", "<OUT>", recipe["qtype"]]


def derive(tool: Quantizer, source: str, out: str, recipe: dict, imatrix: str | None, cwd: str | None = None, timeout: float | None = None):
    return tool.run(source, out, recipe["qtype"], imatrix if recipe["use_imatrix"] else None, recipe["token_embedding_type"], recipe["output_tensor_type"], cwd, timeout)


def matched_recipe(tool: Quantizer, source: str, out: str, candidates: list[str], wanted: dict[str, str], imatrix: str | None, cwd: str | None = None):
    """The first candidate recipes whose output has the wanted tensor types, each tried once more with overrides if only those differ; yields (recipe, seconds)."""
    for qtype in candidates:
        recipe = {"qtype": qtype, "token_embedding_type": None, "output_tensor_type": None, "use_imatrix": imatrix is not None}
        seconds = 0.0
        for _ in range(2):
            run = derive(tool, source, out, recipe, imatrix, cwd)
            seconds += run.seconds
            layout = parse_layout(out) if run.returncode == 0 else {"parse_error": run.tail}
            more = overrides(wanted, type_map(layout)) if layout["parse_error"] is None else None
            if more == {}:
                yield recipe, seconds
            if not more:
                break
            recipe = recipe | {OVERRIDABLE[n]: t.lower() for n, t in more.items()}


def rebuilt(store: BlobStore, entry: Entry, regen: str) -> Iterator[bytes]:
    """The bytes that a plan gives from a regenerated file: header, then payload with its delta."""
    layout = parse_layout(regen)
    if layout["parse_error"] is not None:
        raise BlobError(f"{entry.filename}: regenerated file: {layout['parse_error']}")
    header = store.bytes(entry.header_blob) if entry.header_blob else parse_layout(regen, True)["header"]
    if entry.size - len(header) != layout["data_size"]:
        raise BlobError(f"{entry.filename}: payload of {layout['data_size']} bytes, not {entry.size - len(header)}")
    yield header
    start = layout["data_start"]
    yield from patched(regen, start, store.open(entry.delta_blob)) if entry.delta_blob else tail(regen, start)


def digest_of(chunks: Iterator[bytes]) -> str:
    fold = hashlib.sha256()
    for c in chunks:
        fold.update(c)
    return fold.hexdigest()


def whole(store: BlobStore, path: str, role: str, note: str = "", level: int = LEVEL_FILE) -> Entry:
    return Entry(os.path.basename(path), os.path.getsize(path), file_digest(path), role, "blob", blob=store.put_file(path, level), note=note)


def near_plan(store: BlobStore, path: str, regen: str, recipe: dict) -> Entry | None:
    """The exact or near plan of a file whose recipe gives regen, proved; None if the whole file is the better plan."""
    mine, theirs = parse_layout(path, True), parse_layout(regen, True)
    recipe = recipe | {"cli_flags": cli_flags(recipe)}
    entry = Entry(os.path.basename(path), mine["file_size"], file_digest(path), "quant", "exact", recipe, data_start=mine["data_start"])
    same = file_digest(regen) == entry.sha256
    if not same and not congruent(mine, theirs):
        return None
    # a matrix's path is written into the header, so with one the header is kept whatever it is here
    if recipe["use_imatrix"] or (not same and mine["header"] != theirs["header"]):
        entry.header_blob = store.put([mine["header"]])
    if not same:
        delta = Delta((path, mine["data_start"]), (regen, theirs["data_start"]))
        blob = store.put(delta)
        if delta.differing:
            entry.plan, entry.delta_blob = "near", blob
            share = delta.differing / max(1, mine["data_size"])
            entry.note = f"{share:.3%} of the payload's bytes differ"
            if store.size(blob) > CEILING * entry.size:
                return None
    if (entry.header_blob or not same) and digest_of(rebuilt(store, entry, regen)) != entry.sha256:
        raise PackError(f"{entry.filename}: the plan doesn't give the file back")
    return entry


def planned(work: DataFrame, store: BlobStore, tool: Quantizer | None) -> DataFrame:
    """The entries of files (ord, role, path, candidates, note, source_path, source, imatrix_path, imatrix), one task a file, and the seconds that tools ran for each.

    A derived file is tried; a source or matrix is stored whole.
    """

    def one(r) -> tuple[Entry, float]:
        if r.role != "quant":
            return whole(store, r.path, r.role, level=LEVEL_PATCH if r.role == "imatrix" else LEVEL_FILE), 0.0
        if r.note or tool is None or not r.source_path:
            return whole(store, r.path, "quant", r.note or "no source or no tool to derive with"), 0.0
        if not len(r.candidates):
            return whole(store, r.path, "quant", "neither name nor tensor types suggest a recipe"), 0.0
        with tempfile.TemporaryDirectory() as folder:
            regen = os.path.join(folder, "regen.gguf")
            for recipe, seconds in matched_recipe(tool, r.source_path, regen, list(r.candidates), type_map(parse_layout(r.path)), r.imatrix_path or None):
                entry = near_plan(store, r.path, regen, recipe)
                return entry or whole(store, r.path, "quant", f"recipe {recipe['qtype']} gives the types but not the layout, or too large a delta"), seconds
        return whole(store, r.path, "quant", f"no candidate matched: {', '.join(r.candidates)}"), 0.0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                e, seconds = one(r)
                e.source = (r.source or None) if r.source_path else None
                e.imatrix = (r.imatrix or None) if e.recipe and e.recipe["use_imatrix"] else None
                out.append(asdict(e) | {"ord": int(r.ord), "seconds": seconds})
            yield pd.DataFrame(out, columns=columns)

    schema = f"{ENTRIES}, seconds double"
    columns = ["ord", "filename", "size", "sha256", "role", "plan", "recipe", "header_blob", "delta_blob", "blob", "data_start", "note", "source", "imatrix", "seconds"]
    reachable(work.sparkSession)
    return work.repartition(max(1, work.count()), "path").mapInPandas(run, schema)


def pack(spark: SparkSession, folder: str, out: str, tool: Quantizer | str | None = None, log: Callable[[str], None] = lambda line: None) -> Manifest:
    """Packs a folder; blobs, of sources too, are written by tasks, the manifest last, by the driver.

    A task that is run again writes the same blobs, so retries are harmless; a
    blob that no entry refers to in the end is removed.  log is told of each
    file as it is entered: its plan, note and the seconds of its tools.
    """
    if not os.path.isdir(folder):
        raise PackError(f"not a folder: {folder}")
    if os.path.exists(out) and (not os.path.isdir(out) or os.listdir(out)):
        raise PackError(f"output is there and not an empty folder: {out}")
    files = scan_folder(spark, folder)
    names = {k: sorted(r.path for r in files.where(F.col("klass") == k).collect()) for k in ("gguf", "imatrix")}
    if not names["gguf"]:
        raise PackError(f"no tensor files in {folder}")
    if not isinstance(tool, Quantizer):
        try:
            tool = Quantizer.locate(tool)
        except ToolError as e:
            log(f"no tool, so all files are stored whole: {e}")
            tool = None
    os.makedirs(out, exist_ok=True)
    store = BlobStore(out)
    layouts = described(read_layouts(spark, names["gguf"])).cache()
    models = linked_models(layouts).cache()
    matrices = files.where(F.col("klass") == "imatrix")
    pairs = linked_matrices(models.where("role = 'source'"), matrices)
    at = {os.path.basename(p): p for p in [*names["gguf"], *names["imatrix"]]}
    chosen = {r.source: r.imatrix for r in pairs.collect()}
    sources = [r.name for r in models.where("role = 'source'").orderBy("name").collect()]
    manifest = Manifest(datetime.now(UTC).isoformat(timespec="seconds"), asdict(tool) if tool else {})
    work = []
    by_path = {r.path: r for r in layouts.select("path", "candidates").collect()}
    for r in models.where("role = 'quant'").orderBy("name").collect():
        matrix = chosen.get(r.source, "") if r.source else ""
        work.append((len(work), "quant", r.path, list(by_path[r.path].candidates), r.note or "", at[r.source] if r.source else "", r.source or "", at.get(matrix, ""), matrix))
    for role, path in [*(("source", at[s]) for s in sources), *(("imatrix", p) for p in names["imatrix"])]:
        work.append((len(work), role, path, [], "", "", "", "", ""))
    schema = "ord int, role string, path string, candidates array<string>, note string, source_path string, source string, imatrix_path string, imatrix string"
    rows = planned(spark.createDataFrame(work, schema), store, tool).orderBy("ord").collect()
    entries = [Entry(**{k: (v.asDict() if k == "recipe" and v is not None else v) for k, v in r.asDict().items() if k not in ("ord", "seconds")}) for r in rows]
    took = {r.filename: r.seconds for r in rows}
    those = {e.filename: e for e in entries if e.role != "quant"}
    quants = [e for e in entries if e.role == "quant"]
    for s in sources:
        manifest.files.append(those.pop(s))
        if chosen.get(s) in those:
            manifest.files.append(those.pop(chosen[s]))
        manifest.files += [e for e in quants if e.source == s]
    manifest.files += [e for e in quants if not e.source]
    manifest.files += [those[os.path.basename(p)] for p in names["imatrix"] if os.path.basename(p) in those]
    for e in manifest.files:
        log(f"{e.filename}: {e.plan} {e.note}".rstrip() + (f" ({took[e.filename]:.1f} s)" if took[e.filename] else ""))
    layouts.unpersist()
    models.unpersist()
    store.drop_unreferenced({b for e in manifest.files for b in e.blobs()})
    manifest.save(out)
    return manifest
