"""Scalar functions of the lineage engine as Column expressions: all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quantisation type names, variants that are a type with overrides, and the ordered types that share a block type.
CUSTOM_VARIANTS = {"Q2_K_L": "Q2_K", "Q3_K_XL": "Q3_K_L", "Q4_K_L": "Q4_K_M", "Q4_K_XL": "Q4_K_M", "Q5_K_L": "Q5_K_M", "Q6_K_L": "Q6_K"}
KNOWN_TYPES = (
    "Q4_0 Q4_1 Q5_0 Q5_1 Q8_0 Q2_K Q2_K_S Q3_K Q3_K_S Q3_K_M Q3_K_L Q4_K Q4_K_S Q4_K_M Q5_K Q5_K_S Q5_K_M Q6_K"
    " IQ1_S IQ1_M IQ2_XXS IQ2_XS IQ2_S IQ2_M IQ3_XXS IQ3_XS IQ3_S IQ3_M IQ4_NL IQ4_XS TQ1_0 TQ2_0 Q4_0_4_4 Q4_0_4_8 Q4_0_8_8 F16 BF16 F32"
).split()
SHARED_BLOCKS = {
    "Q2_K": ["Q2_K", "Q2_K_S"],
    "Q3_K": ["Q3_K_M", "Q3_K_L", "Q3_K_S"],
    "Q4_K": ["Q4_K_M", "Q4_K_S"],
    "Q5_K": ["Q5_K_M", "Q5_K_S"],
    "IQ2_S": ["IQ2_M", "IQ2_S"],
    "IQ3_S": ["IQ3_M", "IQ3_S", "IQ3_XS"],
}
OWN_BLOCKS = "Q4_0 Q4_1 Q5_0 Q5_1 Q8_0 Q6_K IQ1_S IQ1_M IQ2_XXS IQ2_XS IQ3_XXS IQ4_NL IQ4_XS TQ1_0 TQ2_0 F16 BF16 F32".split()
#: Codes of tensor types in the public format description.
TYPE_CODES = {
    0: "F32", 1: "F16", 2: "Q4_0", 3: "Q4_1", 6: "Q5_0", 7: "Q5_1", 8: "Q8_0", 9: "Q8_1", 10: "Q2_K", 11: "Q3_K", 12: "Q4_K", 13: "Q5_K", 14: "Q6_K", 15: "Q8_K",
    16: "IQ2_XXS", 17: "IQ2_XS", 18: "IQ3_XXS", 19: "IQ1_S", 20: "IQ4_NL", 21: "IQ3_S", 22: "IQ2_S", 23: "IQ4_XS", 24: "I8", 25: "I16", 26: "I32", 27: "I64", 28: "F64",
    29: "IQ1_M", 30: "BF16", 34: "TQ1_0", 35: "TQ2_0",
}
SOURCE_TYPES = ["F32", "F16", "BF16"]


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for pair in values.items() for x in pair])


def type_name(code: Column) -> Column:
    """Name of a tensor type code; UNKNOWN_n for others."""
    return F.coalesce(F.try_element_at(literal_map(TYPE_CODES), code), F.concat(F.lit("UNKNOWN_"), code.cast("string")))


def type_suffix(filename: Column) -> Column:
    """Upper-case word between the last hyphen and the container's extension, empty if there is none."""
    return F.upper(F.regexp_extract(filename, r"(?i)-([A-Za-z0-9_]+)\.gguf$", 1))


def model_stem(filename: Column) -> Column:
    """Base name without extension and without a trailing -TYPE of a known type or variant."""
    base = F.element_at(F.split(filename, "/"), -1)
    bare = F.when(base.contains("."), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    tail = F.regexp_extract(bare, r"-([A-Za-z0-9_]+)$", 1)
    known = F.upper(tail).isin(*KNOWN_TYPES, *CUSTOM_VARIANTS)
    return F.when((tail != "") & known, F.substring(bare, F.lit(1), F.length(bare) - F.length(tail) - 1)).otherwise(bare)


def recipe_candidates(filename: Column, dominant: Column) -> Column:
    """Ordered types to try: the name's variant or type, else those of the dominant block type; empty if none."""
    suffix = type_suffix(filename)
    blocks = {**{t: [t] for t in OWN_BLOCKS}, **SHARED_BLOCKS}
    return F.coalesce(
        F.when(suffix.isin(*CUSTOM_VARIANTS), F.array(F.element_at(literal_map(CUSTOM_VARIANTS), suffix))),
        F.when(suffix.isin(*KNOWN_TYPES), F.array(suffix)),
        F.try_element_at(literal_map(blocks), dominant),
        F.array().cast("array<string>"),
    )


def common_prefix_length(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings."""
    sizes = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.array_max(F.filter(sizes, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))


def prefix_related(a: Column, b: Column) -> Column:
    """Neither is empty and one starts with the other."""
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.startswith(a, b) | F.startswith(b, a))


def align_up(x: Column, step: int) -> Column:
    return F.floor((x + (step - 1)) / float(step)).cast("long") * step


def is_power_of_two(x: Column) -> Column:
    return (x > 0) & (x.bitwiseAND(x - 1) == 0)


def guarded_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b isn't positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def human_size(n: Column) -> Column:
    """1,234 B, 1.2 KiB ... TiB."""
    out, size = F.concat(F.format_number(n.cast("double") / 1024.0**4, 1), F.lit(" TiB")), n.cast("double")
    for power, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB")):
        out = F.when(size < 1024.0 ** (power + 1), F.concat(F.format_number(size / 1024.0**power, 1), F.lit(f" {unit}"))).otherwise(out)
    return F.when(size < 1024.0, F.concat(F.format_number(n, 0), F.lit(" B"))).otherwise(out)


def parse_size(text: Column) -> Column:
    """Bytes of '10', '1.5G', '2 mb'-like sizes (K, M, G, T, with or without B, any case), null if malformed."""
    form = r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)B?\s*$"
    unit = F.upper(F.regexp_extract(text, form, 2))
    scale = F.element_at(literal_map({"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}), unit)
    return F.when(text.rlike(form), F.floor(F.regexp_extract(text, form, 1).cast("double") * scale).cast("long"))


def substitute(args: Column, path: Column) -> Column:
    """{} replaced in every argument; appended where no argument has it."""
    held = F.exists(args, lambda a: a.contains("{}"))
    return F.when(held, F.transform(args, lambda a: F.replace(a, F.lit("{}"), path))).otherwise(F.concat(args, F.array(path)))


def token_after(command: Column, flag: str) -> Column:
    """The word after a flag in a command line, null if there is none."""
    words = F.split(command, r"\s+")
    at = F.array_position(words, flag)
    return F.when(at > 0, F.try_element_at(words, (at + 1).cast("int")))


def safe_sibling(name: Column) -> Column:
    """A plain file name: not empty, no dots alone, no separators, no white space at the edges."""
    return F.coalesce((F.length(name) > 0) & ~name.isin(".", "..") & ~name.rlike(r"[/\\]") & (F.trim(name) == name) & ~name.rlike(r"^\s|\s$"), F.lit(False))


def safe_relative(name: Column) -> Column:
    """A relative path within a folder: no backslash, no part .., not absolute, no white space at the edges."""
    return F.coalesce((F.length(name) > 0) & ~name.rlike(r"^/|\\|^[A-Za-z]:|^\s|\s$") & ~F.array_contains(F.split(name, "/"), ".."), F.lit(False))


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def reasons(*rules: tuple[Column, str]) -> Column:
    """The texts of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(text)) for rule, text in rules]))


def first_label(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds."""
    out = F
    for rule, label in rules:
        out = out.when(rule, F.lit(label))
    return out.otherwise(F.lit(otherwise))
