import json
import os
import shutil
import subprocess

import files
import pytest

from weftline import cli
from weftline.operators.transform import Quantizer
from weftline.plans import cache, rebuild
from weftline.plans.packer import PackError, overrides, pack
from weftline.plans.prune import PruneError, PruneRefused, prune
from weftline.sources.manifest import AmbiguousName, Manifest, ManifestError, resolved


def derive(tool, *args):
    subprocess.run([tool, *map(str, args)], check=True)


@pytest.fixture(scope="module")
def world(tmp_path_factory, spark):
    at = tmp_path_factory.mktemp("world")
    tool, folder = files.tool(at / "quantize"), at / "models"
    folder.mkdir()
    a = files.model(folder / "tinyA-f16.gguf", 7, "A")
    b = files.model(folder / "tinyB-f16.gguf", 13, "B", vocab=48, embd=64, layers=2)
    for n, s in (("tinyA-Q8_0", a), ("tinyB-Q4_K_M", b), ("tinyB-Q6_K", b)):
        derive(tool, s, folder / f"{n}.gguf", n.split("-")[1])
    near = folder / "tinyA-Q6_K.gguf"
    derive(tool, a, near, "Q6_K")
    files.flip(near, [100, 2000])
    derive(tool, "--token-embedding-type", "q8_0", a, folder / "tinyA-Q4_K_L.gguf", "Q4_K_M")
    derive(tool, a, folder / "tinyA-unnamed.gguf", "Q4_K_S")
    shutil.copy(folder / "tinyA-Q8_0.gguf", folder / "_tinyA-Q8_0.gguf")
    (folder / "tiny-MYSTERY.gguf").write_bytes(bytes(range(256)) * 64)
    (folder / "notes.txt").write_text("x")
    (folder / ".hidden.gguf").write_text("x")
    out = at / "pack"
    said = []
    manifest = pack(spark, str(folder), str(out), tool, said.append)
    assert len(said) == len(manifest.files) and any("near" in line and " s)" in line and "% of the payload" in line for line in said)
    return at, tool, folder, out, manifest


def test_every_plan_and_byte_exact_rebuild(spark, world, tmp_path):
    at, tool, folder, out, manifest = world
    by = {e.filename: e for e in manifest.files}
    assert set(by) == {n for n in os.listdir(folder) if n not in ("notes.txt", ".hidden.gguf")}
    plans = {n: e.plan for n, e in by.items()}
    assert plans["tinyA-Q8_0.gguf"] == plans["tinyB-Q4_K_M.gguf"] == plans["tinyA-Q4_K_L.gguf"] == plans["_tinyA-Q8_0.gguf"] == "exact"
    assert plans["tinyA-Q6_K.gguf"] == "near" and plans["tiny-MYSTERY.gguf"] == "blob" and by["tinyA-f16.gguf"].role == "source"
    assert by["tinyA-Q4_K_L.gguf"].recipe["token_embedding_type"] == "q8_0" and not by["tinyA-Q8_0.gguf"].blobs()
    assert by["tinyA-unnamed.gguf"].plan in ("exact", "near", "blob") and "not parseable" in by["tiny-MYSTERY.gguf"].note
    assert by["tinyB-Q6_K.gguf"].source == "tinyB-f16.gguf"
    for e in manifest.files:
        rebuild.rebuild(str(out), manifest, e, str(tmp_path / "x"), tool)
        assert files.sha(tmp_path / "x") == files.sha(folder / e.filename)
    assert {r.status for r in rebuild.verify(spark, str(out), tool).collect()} == {"OK"}
    assert {r.status for r in rebuild.blob_status(spark, str(out)).collect()} == {"ok"}
    assert {r["plan"]: r["count"] for r in rebuild.plan_counts(spark, str(out)).collect()}["blob"] >= 3
    with pytest.raises(PackError):
        pack(spark, str(folder), str(out), tool)


def test_stats_add_up(spark, world):
    _, _, folder, out, manifest = world
    rows = rebuild.stats(spark, str(out)).collect()
    single = [r for r in rows if r.filename]
    total = rows[-1]
    blobs = sum(os.path.getsize(out / "blobs" / b) for b in {b for e in manifest.files for b in e.blobs()})
    assert total.plan == "total" and total["size"] == sum(e.size for e in manifest.files) == sum(r["size"] for r in single)
    assert sum(r.stored for r in single) == blobs and total.stored == blobs + os.path.getsize(out / "manifest.json")
    assert {r.model for r in rows if r.plan == "subtotal"} == {"tinyA-f16.gguf", "tinyB-f16.gguf", "unmatched"}
    assert [r for r in single if r.filename == "tinyA-Q4_K_L.gguf"][0].recipe == "Q4_K_M+ovr"


def test_imatrix_header_patch_and_twins(spark, tmp_path):
    tool, folder = files.tool(tmp_path / "q"), tmp_path / "m"
    folder.mkdir()
    a = files.model(folder / "base-f16.gguf", 21, "same")
    files.model(folder / "base-abliterated-f16.gguf", 22, "same")
    (folder / "base.imatrix").write_bytes(b"matrix")
    subprocess.run([tool, "--imatrix", "base.imatrix", a, "base-Q8_0.gguf", "Q8_0"], cwd=folder, check=True)
    derive(tool, a, folder / "other-Q8_0.gguf", "Q8_0")
    manifest = pack(spark, str(folder), str(tmp_path / "p"), tool)
    by = {e.filename: e for e in manifest.files}
    one = by["base-Q8_0.gguf"]
    assert one.plan == "exact" and one.header_blob and one.imatrix == "base.imatrix" and one.source == "base-f16.gguf"
    assert by["other-Q8_0.gguf"].plan == "blob" and "ambiguous" in by["other-Q8_0.gguf"].note
    assert {r.status for r in rebuild.verify(spark, str(tmp_path / "p"), tool).collect()} == {"OK"}


def test_refusals_when_bytes_are_wrong(spark, world, tmp_path):
    at, tool, folder, out, manifest = world
    copy = tmp_path / "pack"
    shutil.copytree(out, copy)
    by = {e.filename: e for e in manifest.files}
    blob = copy / "blobs" / by["tinyA-Q6_K.gguf"].delta_blob
    data = bytearray(blob.read_bytes())
    data[len(data) // 2] ^= 1
    blob.write_bytes(data)
    status = {r.filename: r.status for r in rebuild.verify(spark, str(copy), tool).collect()}
    assert status["tinyA-Q6_K.gguf"].startswith("FAIL") and status["tinyA-Q8_0.gguf"] == "OK"
    with pytest.raises(rebuild.RebuildError):
        rebuild.rebuild(str(copy), manifest, by["tinyA-Q6_K.gguf"], str(tmp_path / "x"), tool)
    assert not (tmp_path / "x").exists()
    other = files.tool(tmp_path / "other", b"salt")
    with pytest.raises(rebuild.RebuildError):
        rebuild.rebuild(str(out), manifest, by["tinyA-Q8_0.gguf"], str(tmp_path / "x"), other)
    assert sorted(os.listdir(tmp_path)) == ["other", "pack"]


def test_names_and_strict_manifest(spark, world, tmp_path):
    _, _, _, out, manifest = world
    with pytest.raises(AmbiguousName, match="tinyA-Q6_K.gguf, tinyB-Q6_K.gguf"):
        manifest.find(spark, "Q6_K")
    assert manifest.find(spark, "tinyB-Q6_K.gguf").filename == "tinyB-Q6_K.gguf" and manifest.find(spark, "nothing") is None
    assert manifest.find(spark, "Q4_K_L").filename == "tinyA-Q4_K_L.gguf"
    assert Manifest.load(str(out)) == manifest
    rows = {r.filename: r.source_entry for r in resolved(manifest.frame(spark), "source").collect()}
    assert rows["tinyB-Q6_K.gguf"] == "tinyB-f16.gguf"
    good = json.loads((out / "manifest.json").read_text())
    for bad in ("{", "[]", json.dumps(good | {"format": "x"}), json.dumps(good | {"more": 1}), json.dumps(good | {"files": [good["files"][0] | {"new": 1}]}), json.dumps(good | {"files": [{"filename": "a"}]})):
        (tmp_path / "manifest.json").write_text(bad)
        with pytest.raises(ManifestError):
            Manifest.load(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        Manifest.load(str(tmp_path / "none"))


def test_overrides():
    a = {"token_embd.weight": "Q8_0", "x": "Q4_K"}
    assert overrides(a, a) == {} and overrides(a, a | {"token_embd.weight": "Q4_K"}) == {"token_embd.weight": "Q8_0"}
    assert overrides(a, a | {"x": "Q6_K"}) is None and overrides(a, {"x": "Q4_K"}) is None


def test_prune(spark, world, tmp_path):
    _, tool, folder, out, _ = world
    models, copy = tmp_path / "models", tmp_path / "pack"
    shutil.copytree(folder, models)
    manifest = pack(spark, str(models), str(copy), tool)
    before = sorted(os.listdir(models))

    def refused(error=PruneRefused, keep=None):
        with pytest.raises(error):
            prune(spark, str(models), str(copy), manifest, keep)
        assert sorted(os.listdir(models)) == before

    refused(PruneError, ["nothing"])
    (models / "tinyA-Q8_0.gguf").open("ab").write(b"x")
    refused()
    shutil.copy(folder / "tinyA-Q8_0.gguf", models / "tinyA-Q8_0.gguf")
    source = copy / "blobs" / next(e.blob for e in manifest.files if e.filename == "tinyA-f16.gguf")
    data = source.read_bytes()
    source.write_bytes(data[:-1])
    refused()
    source.unlink()
    refused()
    source.write_bytes(data)
    manifest.files[0].note = "changed"
    refused()
    manifest.files[0].note = ""
    rows = {r.filename: r for r in prune(spark, str(models), str(copy), manifest, ["Q6_K"]).collect()}
    assert rows["tinyA-Q6_K.gguf"].reason == "--keep" and rows["tinyA-f16.gguf"].reason == "source" and rows["tinyA-Q8_0.gguf"].action == "deleted"
    assert sorted(os.listdir(models)) == sorted([".hidden.gguf", "notes.txt", "tinyA-Q6_K.gguf", "tinyB-Q6_K.gguf", "tinyA-f16.gguf", "tinyB-f16.gguf"])
    assert {r.status for r in rebuild.verify(spark, str(copy), tool).collect()} == {"OK"}


def test_cache(spark, world, tmp_path, monkeypatch):
    _, tool, folder, out, _ = world
    root = str(tmp_path / "c")
    path = cache.get(spark, str(out), "tinyA-Q8_0.gguf", tool, root)
    assert files.sha(path) == files.sha(folder / "tinyA-Q8_0.gguf")
    assert cache.get(spark, str(out), "tinyA-Q8_0.gguf", "/no/tool", root) == path
    open(path, "ab").write(b"x")
    assert files.sha(cache.get(spark, str(out), "tinyA-Q8_0.gguf", tool, root)) == files.sha(folder / "tinyA-Q8_0.gguf")
    cache.get(spark, str(out), "tinyB-Q6_K.gguf", tool, root)
    assert [r.filename for r in cache.cached(spark, root).collect()] == ["tinyA-Q8_0.gguf", "tinyB-Q6_K.gguf"]
    os.utime(path, (500, 500))
    size = os.path.getsize(os.path.join(os.path.dirname(path), "tinyB-Q6_K.gguf"))
    assert cache.evict(spark, size, protect=path, root=root).count() == 1
    monkeypatch.setenv("WEFTLINE_CACHE_MAX", "1K")
    path = cache.get(spark, str(out), "tinyB-Q6_K.gguf", tool, root)
    assert [r.path for r in cache.cached(spark, root).collect()] == [path]
    monkeypatch.setenv("WEFTLINE_CACHE_MAX", "lots")
    cache.get(spark, str(out), "tinyB-Q6_K.gguf", tool, root)
    assert cache.clear(spark, "0" * 7, root) == 0 and cache.clear(spark, cache.pack_id(str(out))[:8], root) == 1
    assert cache.cached(spark, root).count() == 0 and cache.clear(spark, root=root) == 0


def test_eviction_order(spark, tmp_path):
    for pack_, name, size, at in (("p", "a", 1000, 500), ("p", "b", 1000, 1000), ("q", "c", 1000, 3000), ("q", "d", 1000, 4000)):
        (tmp_path / pack_).mkdir(exist_ok=True)
        (tmp_path / pack_ / name).write_bytes(b"x" * size)
        os.utime(tmp_path / pack_ / name, (at, at))
    assert sorted(os.path.basename(r.path) for r in cache.evict(spark, 2000, root=str(tmp_path)).collect()) == ["a", "b"]
    assert os.listdir(tmp_path) == ["q"]


def test_command_line(spark, world, tmp_path, capsys, monkeypatch):
    _, tool, folder, out, _ = world
    monkeypatch.setenv("WEFTLINE_CACHE", str(tmp_path / "cache"))
    assert cli.main(["pack", str(folder), "-o", str(tmp_path / "p"), "--keep", "x"], spark) == 1
    assert cli.main(["nonsense"], spark) == 1
    assert cli.main(["pack", str(folder), "-o", str(tmp_path / "p"), "--llama-quantize", tool], spark) == 0
    assert cli.main(["verify", str(tmp_path / "p"), "--llama-quantize", tool], spark) == 0
    capsys.readouterr()
    assert cli.main(["get", str(tmp_path / "p"), "tinyA-Q8_0.gguf", "--llama-quantize", tool], spark) == 0
    path = capsys.readouterr().out.strip()
    assert files.sha(path) == files.sha(folder / "tinyA-Q8_0.gguf")
    assert cli.main(["get", str(tmp_path / "p"), "Q6_K"], spark) == 1
    assert cli.main(["exec", str(tmp_path / "p"), "tinyA-Q8_0.gguf", "--", "test", "-f", "{}"], spark) == 0
    assert cli.main(["exec", str(tmp_path / "p"), "tinyA-Q8_0.gguf", "--", "sh", "-c", "exit 7"], spark) == 7
    assert cli.main(["exec", str(tmp_path / "p"), "tinyA-Q8_0.gguf", "--", "sh", "-c", "kill -9 $$"], spark) == 137
    capsys.readouterr()
    for none in ([], ["--"]):
        assert cli.main(["exec", str(tmp_path / "p"), "tinyA-Q8_0.gguf", *none], spark) == 1 and "needs a command" in capsys.readouterr().err
    wide = cli.table([("a" * 60, "1"), ("b", "22")], ("NAME", "N"), "<>").splitlines()
    assert {len(line) for line in wide} == {64} and wide[2].endswith("  " + " 1")
    assert cli.main(["cache", "ls"], spark) == 0 and cli.main(["cache", "prune", "--max-size", "x"], spark) == 1 and cli.main(["cache", "clear"], spark) == 0
    assert cli.main(["stats", str(tmp_path / "p")], spark) == 0
    (tmp_path / "p" / "manifest.json").write_text("{")
    assert cli.main(["stats", str(tmp_path / "p")], spark) == 2
    assert cli.child_argv(["--", "a"], "/p") == ["a", "/p"] and cli.child_argv(["x{}", "y"], "/p") == ["x/p", "y"]
    assert Quantizer.locate(tool).version == "1234 (abc)"
