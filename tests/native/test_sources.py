import hashlib
import os
import struct
import tempfile

import files
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import relational as R
from weftline.operators.bytes import (
    BlobError,
    BlobStore,
    Delta,
    DeltaError,
    deflate_column,
    delta_roundtrip,
    emit,
    inflate_column,
    nonzero,
    nonzero_column,
    patched,
    tail,
    xor,
    xor_column,
)
from weftline.plans.identity import described
from weftline.plans.packer import congruent
from weftline.sources.folders import closure, digests, scan_folder
from weftline.sources.layouts import parse_layout, read_chunks, read_layouts


def test_layout(tmp_path, spark):
    path = files.model(tmp_path / "_a-f16.gguf", extra={"general.alignment": 64})
    one = parse_layout(str(path), True)
    assert one["parse_error"] is None and len(one["tensors"]) == 12 and one["alignment"] == 64 and one["version"] == 3
    data = open(path, "rb").read()
    assert one["header"] == data[: one["data_start"]] and one["data_start"] + one["data_size"] == len(data)
    at = one["kv_string_locs"]["general.name"]
    assert data[at["off"] : at["off"] + at["len"]] == b"tiny"
    longer = parse_layout(str(files.model(tmp_path / "b.gguf", name="another name")))
    plain = parse_layout(str(files.model(tmp_path / "c.gguf")))
    assert congruent(longer, plain) and longer["data_start"] != plain["data_start"] or longer["header_end"] != plain["header_end"]
    for kind, form, value in ((10, "<Q", 256), (0, "<B", 64), (5, "<i", 128), (12, "<d", 32.0), (5, "<i", -32), (10, "<Q", 48), (6, "<f", float("nan")), (7, "<?", True)):
        files.write_gguf(tmp_path / "w.gguf", {"general.alignment": (kind, struct.pack(form, value))}, [("x", (4,), 0, b"0123456789abcdef")], alignment=int(value) if value == value and value > 0 else 32)
        got = parse_layout(str(tmp_path / "w.gguf"))
        assert (got["alignment"] == value and got["data_start"] % value == 0) if value in (256, 64, 128, 32.0, True) else "alignment" in got["parse_error"]
    bad = [b"\0" * 4096, data[:40], b"", data[:4] + b"\x09" + data[5:], data[:8] + b"\xff" * 8 + data[16:]]
    paths = [str(path)]
    for i, b in enumerate(bad):
        (tmp_path / f"bad{i}.gguf").write_bytes(b)
        paths.append(str(tmp_path / f"bad{i}.gguf"))
    rows = {r.path: r for r in read_layouts(spark, [*paths, str(tmp_path / "none.gguf")], header=True).collect()}
    assert rows[str(path)].parse_error is None and bytes(rows[str(path)].header) == one["header"] and rows[str(path)].tensors[0].name == "token_embd.weight"
    assert all(rows[p].parse_error for p in rows if p != str(path)) and len(rows) == 7
    for cut in range(0, one["data_start"], 7):
        (tmp_path / "cut.gguf").write_bytes(data[:cut])
        assert parse_layout(str(tmp_path / "cut.gguf"))["parse_error"]


def test_identity_and_candidates(tmp_path, spark):
    a, b = files.model(tmp_path / "m-f16.gguf", 1), files.model(tmp_path / "m-Q4_K_L.gguf", 2, kind="Q4_K")
    c, d = files.model(tmp_path / "m-nothing.gguf", 3, kind="Q4_K"), files.model(tmp_path / "n.gguf", 4, vocab=8)
    rows = {r.name: r for r in described(read_layouts(spark, [str(p) for p in (a, b, c, d)])).collect()}
    assert rows["m-f16.gguf"].identity == rows["m-Q4_K_L.gguf"].identity != rows["n.gguf"].identity
    assert rows["m-f16.gguf"].dominant == "F16" and rows["m-Q4_K_L.gguf"].candidates == ["Q4_K_M"] and rows["m-nothing.gguf"].candidates == ["Q4_K_M", "Q4_K_S"]
    assert [rows[n].stem for n in ("m-f16.gguf", "m-Q4_K_L.gguf", "m-nothing.gguf", "n.gguf")] == ["m", "m", "m-nothing", "n"]


def test_folders(tmp_path, spark):
    for n in ("a.GGUF", "_b.gguf", "x.imatrix", "imatrix.dat", "note.txt", ".hid.gguf"):
        (tmp_path / n).write_text(n)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c").write_text("c")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "d").write_text("d")
    rows = {r.name: r.klass for r in scan_folder(spark, str(tmp_path)).collect()}
    assert rows == {"a.GGUF": "gguf", "_b.gguf": "gguf", "x.imatrix": "imatrix", "imatrix.dat": "imatrix", "note.txt": "skipped"}
    found = {r.name: r.sha256 for r in closure(spark, str(tmp_path)).collect()}
    assert set(found) == {*rows, "sub/c"} and found["sub/c"] == hashlib.sha256(b"c").hexdigest()
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        closure(spark, str(tmp_path / "empty"))
    gone = spark.createDataFrame([(str(tmp_path / "none"), 1)], "path string, n long")
    assert digests(gone).first().sha256 is None


def test_chunks_and_deltas(tmp_path, spark):
    data = os.urandom(100_000)
    other = bytearray(data)
    for p in (0, 5, 99_999, 40_000):
        other[p] ^= 0xFF
    (tmp_path / "a").write_bytes(b"head" + data)
    (tmp_path / "b").write_bytes(b"longer" + other)
    a = read_chunks(spark, str(tmp_path / "a"), 4, chunk=7000).withColumnRenamed("bytes", "x")
    b = read_chunks(spark, str(tmp_path / "b"), 6, chunk=7000).select("chunk_idx", F.col("bytes").alias("y"))
    both = a.join(b, "chunk_idx", "full").withColumn("d", xor_column("x", "y"))
    assert both.agg(F.sum(nonzero_column("d"))).first()[0] == 4
    back = both.select("chunk_idx", xor_column("d", "y").alias("x")).orderBy("chunk_idx").collect()
    assert b"".join(bytes(r.x) for r in back) == data
    ab = (str(tmp_path / "a"), 4), (str(tmp_path / "b"), 6)
    delta = Delta(*ab)
    whole = b"".join(delta)
    assert whole == xor(data, bytes(other)) and delta.differing == 4 and b"".join(tail(*ab[0])) == data
    assert b"".join(patched(*ab[0], [whole[:7], whole[7:50_000], whole[50_000:]])) == bytes(other)
    for short in ([whole[:-1]], [whole, b"x"]):
        with pytest.raises(DeltaError):
            list(patched(*ab[0], short))
    with pytest.raises(DeltaError):
        list(Delta(ab[0], (str(tmp_path / "b"), 5)))
    with pytest.raises(Exception, match="bytes at"):
        read_chunks(spark, str(tmp_path / "a"), 4, 100_001).collect()
    assert nonzero(xor(data, data)) == 0 and read_chunks(spark, str(tmp_path / "a"), 4, 0).count() == 0


@settings(deadline=None)
@given(st.binary(max_size=60), st.lists(st.integers(1, 17), max_size=8))
def test_a_delta_however_it_is_cut(data, sizes):
    with tempfile.NamedTemporaryFile() as file:
        file.write(b"head" + data)
        file.flush()
        delta, at, pieces = bytes(range(len(data))), 0, []
        for n in [*sizes, len(data)]:
            pieces.append(delta[at : at + n])
            at += n
        assert b"".join(patched(file.name, 4, pieces)) == xor(data, delta)


def test_columns_of_bytes_with_nulls_empties_and_slices(spark):
    rows = [(1, b"abc", b"abd"), (2, None, b"xx"), (3, b"yy", None), (4, None, None), (5, b"", b""), (6, b"\0\1", b"\0\1"), (7, b"zz", b"ZZ")]
    frame = spark.createDataFrame(rows, "id int, a binary, b binary").coalesce(1)
    got = frame.select("id", xor_column("a", "b").alias("x"), nonzero_column("a").alias("n"), inflate_column(deflate_column("a")).alias("same")).orderBy("id").collect()
    assert [r.x and bytes(r.x) for r in got] == [b"\0\0\7", None, None, None, b"", b"\0\0", b"  "]
    assert [r.n for r in got] == [3, None, 2, None, 0, 1, 2] and [r.same and bytes(r.same) for r in got] == [r[1] for r in rows]
    once = delta_roundtrip(frame.where("id > 1"), "a", "b").orderBy("id").collect()
    assert [(r.restored, r.differing) for r in once] == [(None, None)] * 3 + [(True, 0), (True, 0), (True, 2)]
    assert delta_roundtrip(frame.limit(0), "a", "b").collect() == []
    with pytest.raises(Exception, match="different lengths"):
        spark.createDataFrame([(b"a", b"bc")], "a binary, b binary").select(xor_column("a", "b")).collect()


def test_blobs(tmp_path):
    store = BlobStore(str(tmp_path))
    a, b = store.put([b"x" * 1000, b"y"]), store.put([b"x" * 1001])
    assert store.put([b"x" * 1000 + b"y"]) in (a, store.put([b"x" * 1000, b"y"])) and store.bytes(a) == b"x" * 1000 + b"y"
    assert set(os.listdir(tmp_path / "blobs")) >= {a, b} and store.size(a) < 1000
    emit(str(tmp_path / "out"), store.open(a), hashlib.sha256(b"x" * 1000 + b"y").hexdigest())
    with pytest.raises(BlobError):
        emit(str(tmp_path / "no"), store.open(b), "0" * 64)
    assert not (tmp_path / "no").exists()
    raw = bytearray((tmp_path / "blobs" / a).read_bytes())
    raw[-1] ^= 1
    (tmp_path / "blobs" / a).write_bytes(raw)
    with pytest.raises(BlobError, match="corrupt"):
        store.bytes(a)
    assert a in store.drop_unreferenced({b}) and store.bytes(b)
    with pytest.raises(BlobError, match="missing"):
        store.bytes(a)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    stems = {
        "Llama-3.2-1B-Instruct-Q4_K_M.gguf": "Llama-3.2-1B-Instruct",
        "Llama-3.2-1B-Instruct-f16.gguf": "Llama-3.2-1B-Instruct",
        "Llama-3.2-1B-Instruct.imatrix": "Llama-3.2-1B-Instruct",
        "a-Q4_K_XL.gguf": "a",
        "dir/b-q8_0.GGUF": "b",
        "plain": "plain",
        "c-base.gguf": "c-base",
    }
    rows = spark.createDataFrame([(k, v) for k, v in stems.items()], "name string, want string")
    assert rows.where(S.model_stem(F.col("name")) != F.col("want")).collect() == []
    sizes = {"10": 10, "1.5G": 3 << 29, "2 MiB": None, "2M": 2 << 20, "3kb": 3072, "1T": 1 << 40, "0.5K": 512, "": None, "x": None, "-1": None, "1.5.2": None, "K": None, " 7 ": 7}
    assert {k: one(spark, S.parse_size(F.lit(k))) for k in sizes} == sizes
    human = {0: "0 B", 1023: "1,023 B", 1024: "1.0 KiB", 1536: "1.5 KiB", 5 << 20: "5.0 MiB", 3 << 40: "3.0 TiB", 1 << 52: "4,096.0 TiB"}
    assert {k: one(spark, S.human_size(F.lit(k).cast("long"))) for k in human} == human
    names = {"a": True, "a b": True, "": False, ".": False, "..": False, "a/b": False, "a\\b": False, " a": False, "a\n": False}
    assert {k: one(spark, S.safe_sibling(F.lit(k))) for k in names} == names
    paths = {"a/b": True, "../a": False, "/a": False, "a/../b": False, "a\\b": False, "": False, "a..b/c": True}
    assert {k: one(spark, S.safe_relative(F.lit(k))) for k in paths} == paths
    assert one(spark, S.type_name(F.lit(12))) == "Q4_K" and one(spark, S.type_name(F.lit(99))) == "UNKNOWN_99"
    assert one(spark, S.token_after(F.lit("a --x b"), "--x")) == "b" and one(spark, S.token_after(F.lit("a --x"), "--x")) is None
    assert one(spark, S.substitute(F.array(F.lit("a")), F.lit("p"))) == ["a", "p"]


@settings(deadline=None)
@given(st.text("ab-", max_size=6), st.text("ab-", max_size=6))
def test_common_prefix(spark, a, b):
    assert one(spark, S.common_prefix_length(F.lit(a), F.lit(b))) == len(os.path.commonprefix([a, b]))


def test_winners_and_steps(spark):
    rows = spark.createDataFrame([("q", "model-a", "model-a", "A"), ("q", "model-a", "model-ab", "B"), ("r", "model", "model-x", "X"), ("r", "model", "model-y", "Y"), ("s", "z", "model", "M")], "k string, mine string, theirs string, v string")
    assert {r.k: r.winner for r in R.affinity_winner(rows, ["k"], "mine", "theirs", "v").collect()} == {"q": "A", "r": None}
    steps = [F.col("v") == "nothing", F.col("k") == "r", F.lit(True)]
    assert sorted(r.v for r in R.first_matching_step(rows, steps).collect()) == ["X", "Y"]
    assert R.first_matching_step(rows, [F.lit(False)]).collect() == []
    pairs = R.prefix_pairs(spark.createDataFrame([("ab",), ("a",), ("",)], "x string"), spark.createDataFrame([("a",), ("abc",), ("",)], "y string"), "x", "y")
    assert sorted(map(tuple, pairs.collect())) == [("a", "a"), ("a", "abc"), ("ab", "a"), ("ab", "abc")]


def test_running_sum_with_ties_and_nulls(spark):
    rows = [(i, i // 3 if i % 10 else None, i) for i in range(500)]
    for per in (70, 1000):
        got = {r.id: r.before for r in R.running_sum(spark.createDataFrame(rows, "id long, at long, v long"), ["at", "id"], F.col("v"), "before", rows_per_range=per).collect()}
        total = 0
        for i, _, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
            assert got[i] == total
            total += v
