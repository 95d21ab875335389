"""The manifest of a pack: a small JSON file, read strictly, and its entries as a DataFrame."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.relational import first_matching_step

FORMAT, FILE = "weftline-pack/1", "manifest.json"
ENTRIES = """ord int, filename string, size long, sha256 string, role string, plan string,
 recipe struct<qtype: string, token_embedding_type: string, output_tensor_type: string, use_imatrix: boolean, cli_flags: array<string>>,
 header_blob string, delta_blob string, blob string, data_start long, note string, source string, imatrix string"""


class ManifestError(ValueError):
    """The manifest isn't one that this version fully understands."""


class AmbiguousName(LookupError):
    """A type names several files; a file name must be given."""


@dataclass
class Entry:
    filename: str
    size: int
    sha256: str
    role: str
    plan: str
    recipe: dict | None = None
    header_blob: str | None = None
    delta_blob: str | None = None
    blob: str | None = None
    data_start: int | None = None
    note: str = ""
    source: str | None = None
    imatrix: str | None = None

    def blobs(self) -> list[str]:
        return [b for b in (self.header_blob, self.delta_blob, self.blob) if b]


@dataclass
class Manifest:
    created: str
    tool: dict
    files: list[Entry] = field(default_factory=list)
    format: str = FORMAT

    def save(self, folder: str) -> None:
        aside = os.path.join(folder, f".{FILE}.aside")
        with open(aside, "w") as file:
            json.dump(asdict(self), file, indent=1)
            file.write("\n")
        os.replace(aside, os.path.join(folder, FILE))

    @classmethod
    def load(cls, folder: str) -> Manifest:
        try:
            with open(os.path.join(folder, FILE), "rb") as file:
                data = json.loads(file.read())
        except OSError as e:
            raise FileNotFoundError(f"no manifest in {folder}") from e
        except ValueError as e:
            raise ManifestError(f"{folder}: not valid JSON ({e})") from e
        if not isinstance(data, dict) or data.get("format") != FORMAT:
            raise ManifestError(f"{folder}: not of format {FORMAT}")
        if set(data) != {f.name for f in fields(cls)} or not isinstance(data["files"], list):
            raise ManifestError(f"{folder}: fields missing or unknown: {sorted(set(data) ^ {f.name for f in fields(cls)})}")
        known = {f.name for f in fields(Entry)}
        for e in data["files"]:
            if not isinstance(e, dict) or set(e) != known:
                raise ManifestError(f"{folder}: entry fields missing or unknown: {sorted(set(e) ^ known) if isinstance(e, dict) else e!r}")
        return cls(data["created"], data["tool"], [Entry(**e) for e in data["files"]])

    def frame(self, spark: SparkSession) -> DataFrame:
        """The entries, in order of ord."""
        rows = [(i, *(getattr(e, f.name) if f.name != "recipe" else e.recipe and tuple(e.recipe.get(k) for k in RECIPE) for f in fields(Entry))) for i, e in enumerate(self.files)]
        return spark.createDataFrame(rows, ENTRIES)

    def of(self, entry: Entry, role: str) -> Entry | None:
        """The source or imatrix that an entry names, None if it dangles; the first of the role if it names none."""
        named = getattr(entry, role)
        return next((e for e in self.files if e.role == role and named in (None, e.filename)), None)

    def find_all(self, spark: SparkSession, name: str) -> list[Entry]:
        """Entries by file name, else by the -TYPE their names end with, else by their recipe's type: all of the first that has any."""
        bare = F.upper(F.regexp_replace("filename", r"(?i)\.gguf$", ""))
        rows = self.frame(spark).where((F.col("role") == "quant") | (F.col("filename") == name))
        steps = [F.col("filename") == name, bare.endswith(f"-{name.upper()}"), F.upper("recipe.qtype") == name.upper()]
        found = [self.files[r.ord] for r in first_matching_step(rows, steps).orderBy("ord").collect()]
        return found[:1] if found and found[0].filename == name else found

    def find(self, spark: SparkSession, name: str) -> Entry | None:
        found = self.find_all(spark, name)
        if len(found) > 1:
            raise AmbiguousName(f"ambiguous type {name!r}, candidates: {', '.join(sorted(e.filename for e in found))}; use a file name")
        return found[0] if found else None


RECIPE = ["qtype", "token_embedding_type", "output_tensor_type", "use_imatrix", "cli_flags"]


def resolved(entries: DataFrame, role: str) -> DataFrame:
    """entries with the entry of a role each depends on: the one it names, null if that dangles, else the first of the role."""
    those = entries.where(F.col("role") == role).select(F.col("filename").alias("known"), F.col("ord").alias("at"))
    first = those.agg(F.min_by("known", "at").alias("first")).first()["first"]
    out = entries.join(those.select("known").distinct(), F.col(role) == F.col("known"), "left")
    return out.withColumn(f"{role}_entry", F.when(F.col(role).isNotNull(), F.col("known")).otherwise(F.lit(first))).drop("known")


def snapshot_diff(a: Manifest, b: Manifest) -> bool:
    """True if two manifests differ in anything, order included."""
    return asdict(a) != asdict(b)
