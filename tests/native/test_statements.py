import copy
import hashlib
import json
import os
import subprocess

import files
import pytest

from weftline import cli
from weftline.operators.transform import Converter
from weftline.plans import statements as P

D = "0" * 64
DERIVATION = {
    "_type": P.STATEMENT,
    "predicateType": P.DERIVATION,
    "subject": [{"name": "q.gguf", "digest": {"sha256": D}}],
    "predicate": {
        "baseModel": {"name": "b.gguf", "digest": {"sha256": D}},
        "recipe": {"quantType": "Q8_0", "useImatrix": False},
        "builder": {"buildIdentity": {"binarySha256": D}},
        "reproducibility": {"deterministic": True, "reDerivedDigest": {"sha256": D}},
    },
}
CONVERSION = {
    "_type": P.STATEMENT,
    "predicateType": P.CONVERSION,
    "subject": [{"name": "f.gguf", "digest": {"sha256": D}}],
    "predicate": {
        "source": {"directoryName": "repo", "files": [{"name": "config.json", "digest": {"sha256": D}}, {"name": "a/b", "digest": {"sha256": D}}]},
        "recipe": {"command": "python x --outfile o d"},
        "builder": {"buildIdentity": {}},
        "reproducibility": {},
    },
}


def changed(base, path, value):
    out = copy.deepcopy(base)
    at = out
    for k in path[:-1]:
        at = at[k]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(out)


def reasons(spark, texts, kind):
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [r.reasons for r in P.check_statements(frame, kind).orderBy("id").collect()]


def test_hostile_derivations(spark):
    p, good = "predicate", json.dumps(DERIVATION)
    bad = [
        "{", "[]", "3", "null", "",
        *[changed(DERIVATION, ("subject", 0, "name"), v) for v in ("", ".", "..", "a/b", "a\\b", " a", "/etc/x", 5, None, KeyError)],
        *[changed(DERIVATION, ("subject", 0, "digest", "sha256"), v) for v in ("", "0" * 63, "G" * 64, "A" * 64, 1, None)],
        *[changed(DERIVATION, (p, "recipe", "quantType"), v) for v in ("", "--flag", "a b", "x" * 33, "a/b", 4, None, KeyError)],
        *[changed(DERIVATION, (p, "recipe", k), v) for k in ("tokenEmbeddingType", "outputTensorType") for v in ("-x", 7, "", {})],
        *[changed(DERIVATION, (p, k), v) for k in ("baseModel", "recipe", "builder", "reproducibility") for v in (KeyError, 3, [])],
        changed(DERIVATION, (p, "builder", "buildIdentity"), KeyError),
        changed(DERIVATION, (p, "recipe", "useImatrix"), True),
        changed(changed(DERIVATION, (p, "recipe", "useImatrix"), True) and DERIVATION | {p: DERIVATION[p] | {"recipe": {"quantType": "Q8_0", "useImatrix": True, "imatrix": {"name": "x", "digest": {"sha256": D}}}}}, (p, "recipe", "imatrix", "name"), "../x"),
        *[changed(DERIVATION, (p, "reproducibility", "reDerivedDigest"), v) for v in ({"sha256": "1" * 64}, {}, "x")],
        changed(DERIVATION, ("subject",), []),
        changed(DERIVATION, ("subject",), DERIVATION["subject"] * 2),
        changed(DERIVATION, ("_type",), "x"),
        changed(DERIVATION, ("predicateType",), P.CONVERSION),
    ]
    found = reasons(spark, [good, changed(DERIVATION, (p, "reproducibility", "reDerivedDigest"), KeyError), *bad], P.DERIVATION)
    assert found[0] == [] and found[1] == [] and all(found[2:]), [b for b, f in zip(bad, found[2:], strict=True) if not f]


def test_hostile_conversions(spark):
    p, s = "predicate", ("predicate", "source")
    bad = [
        *[changed(CONVERSION, (*s, "files", 0, "name"), v) for v in ("", "/a", "../a", "a/../b", "a\\b", " a", "a/b", 3, KeyError)],
        *[changed(CONVERSION, (*s, "files", 0, "digest"), v) for v in (KeyError, {}, {"sha256": "x"})],
        *[changed(CONVERSION, (*s, "files"), v) for v in ([], {}, KeyError, "x", [3])],
        *[changed(CONVERSION, (*s, "directoryName"), v) for v in ("..", "a/b", "", KeyError)],
        *[changed(CONVERSION, (p, "recipe", "command"), v) for v in (KeyError, 3, "x --model-name --evil", "x --model-name a;b", "x --model-name")],
        changed(CONVERSION, (p, "builder", "buildIdentity"), KeyError),
        changed(CONVERSION, (p, "reproducibility", "reDerivedDigest"), {"sha256": "1" * 64}),
    ]
    found = reasons(spark, [json.dumps(CONVERSION), *bad], P.CONVERSION)
    assert found[0] == [] and all(found[1:]), [b for b, f in zip(bad, found[1:], strict=True) if not f]


@pytest.fixture
def world(tmp_path):
    tool, script = files.tool(tmp_path / "quantize"), files.converter(tmp_path / "convert_hf_to_gguf.py")
    repo = tmp_path / "tiny-repo"
    repo.mkdir()
    for n in ("config.json", "model.safetensors", "README.md"):
        (repo / n).write_text(n)
    converter = Converter.locate(script=script)
    assert converter.run(str(repo), str(tmp_path / "tiny-f16.gguf")).returncode == 0
    (tmp_path / "m.imatrix").write_bytes(b"matrix")
    subprocess.run([tool, "--imatrix", "m.imatrix", "tiny-f16.gguf", "tiny-Q8_0.gguf", "Q8_0"], cwd=tmp_path, check=True)
    return tmp_path, tool, converter, repo


def test_attest_verify_and_chain(spark, world):
    at, tool, converter, repo = world
    quant, f16 = str(at / "tiny-Q8_0.gguf"), str(at / "tiny-f16.gguf")
    leaf, root = str(at / "leaf.json"), str(at / "root.json")
    with pytest.raises(P.StatementError):
        P.attest(spark, quant, f16, None, tool)
    with pytest.raises(P.StatementError, match="overrides need"):
        P.attest(spark, quant, f16, None, tool, embedding="q8_0")
    made = P.attest(spark, quant, f16, str(at / "m.imatrix"), tool, deterministic=True)
    assert made["predicate"]["recipe"]["quantType"] == "Q8_0" and made["predicate"]["recipe"]["imatrix"]["name"] == "m.imatrix"
    P.save_statement(made, leaf)
    assert P.verify(spark, leaf, tool) == ""
    other = files.tool(at / "other")
    with open(other, "a") as f:
        f.write("# another build, same output\n")
    assert "another build" in P.verify(spark, leaf, other)
    with pytest.raises(P.VerifyFailed, match="INCONCLUSIVE.*deterministic"):
        P.verify(spark, leaf, files.tool(at / "third", b"salt"))
    P.save_statement(P.attest_conversion(spark, f16, str(repo), converter), root)
    assert P.verify_conversion(spark, root, converter) == "" and P.verify_chain(spark, leaf, root, tool, converter) == []
    args = ["--llama-quantize", tool, "--converter", converter.script, "--python", converter.python]
    assert cli.main(["verify-chain", leaf, root, *args], spark) == 0 and cli.main(["verify-attestation", leaf, "--llama-quantize", tool], spark) == 0
    assert cli.main(["verify-attestation", str(at / "none"), "--llama-quantize", tool], spark) == 1
    wrong = copy.deepcopy(made)
    wrong["subject"][0]["digest"]["sha256"] = wrong["predicate"]["reproducibility"]["reDerivedDigest"]["sha256"] = "1" * 64
    os.rename(quant, quant + ".away")
    P.save_statement(wrong, leaf)
    with pytest.raises(P.VerifyFailed, match="TAMPER-EVIDENT"):
        P.verify(spark, leaf, tool)
    assert cli.main(["verify-attestation", leaf, "--llama-quantize", tool], spark) == 2
    wrong["predicate"]["baseModel"]["digest"]["sha256"] = "2" * 64
    P.save_statement(wrong, leaf)
    with pytest.raises(P.VerifyFailed, match="aren't linked"):
        P.verify_chain(spark, leaf, root, tool, converter)
    with pytest.raises(P.VerifyFailed, match="base model"):
        P.verify(spark, leaf, tool)


def test_tampering(spark, world):
    at, tool, converter, repo = world
    root = str(at / "root.json")
    P.save_statement(P.attest_conversion(spark, str(at / "tiny-f16.gguf"), str(repo), converter), root)
    (repo / "extra").write_text("x")
    with pytest.raises(P.VerifyFailed, match="outside"):
        P.verify_conversion(spark, root, converter)
    (repo / "extra").unlink()
    (repo / ".hidden").write_text("fine")
    assert P.verify_conversion(spark, root, converter) == ""
    (repo / "README.md").write_text("changed")
    with pytest.raises(P.VerifyFailed, match="closure digest"):
        P.verify_conversion(spark, root, converter)
    (repo / "README.md").unlink()
    with pytest.raises(FileNotFoundError):
        P.verify_conversion(spark, root, converter)
    (repo / "README.md").write_text("README.md")
    files.flip(at / "tiny-f16.gguf", [3])
    with pytest.raises(P.VerifyFailed, match="subject"):
        P.verify_conversion(spark, root, converter)
    with pytest.raises(P.StatementError):
        P.attest_conversion(spark, str(at / "tiny-f16.gguf"), str(repo), converter)


def test_published_digests():
    good = {"digest": {"sha256": D}, "downloadLocation": "https://huggingface.co/a/b/resolve/main/x.gguf"}
    pointer = b"version https://git-lfs.github.com/spec/v1\noid sha256:" + D.encode() + b"\nsize 3\n"
    P.check_published(good, lambda url: pointer)
    P.check_published(good, lambda url: iter([pointer[:20], pointer[20:]]))
    with pytest.raises(P.VerifyFailed, match="published digest"):
        # a body that only holds such a line is a body
        P.check_published(good, lambda url: b"notes\n" + pointer)
    with pytest.raises(P.VerifyFailed, match="no digest"):
        P.check_published(good, lambda url: pointer[:45])
    body = [b"x" * 1000] * 50
    P.check_published(good | {"digest": {"sha256": hashlib.sha256(b"".join(body)).hexdigest()}}, lambda url: iter(body))
    for bad in ("?download=true", "#x", "/../y", "%2e", "?"):
        with pytest.raises(P.VerifyFailed, match="no published place"):
            P.check_published(good | {"downloadLocation": good["downloadLocation"] + bad}, lambda url: pointer)
    for place in ("http://huggingface.co/a/b/resolve/main/x", "https://huggingface.co.example/a/b/resolve/main/x", "https://u@huggingface.co/a/b/resolve/main/x", "https://huggingface.co/a/b/blob/main/x", "https://huggingface.co/a/b/resolve/main/"):
        assert P.published_place(place) is None
    assert P.published_place("https://huggingface.co/a/b/resolve/r1/dir/x.gguf") == ("a/b", "r1", "dir/x.gguf")
    with pytest.raises(P.VerifyFailed, match="published digest"):
        P.check_published(good, lambda url: b"content")
    with pytest.raises(P.VerifyFailed, match="no published place"):
        P.check_published({"digest": {"sha256": D}})

    def offline(url):
        raise OSError("offline")

    with pytest.raises(P.VerifyFailed, match="offline"):
        P.check_published(good, offline)
    view = P.identity_view({"files": [{"name": "a"}, {"name": "m.safetensors", "digest": {}}], "uri": "pkg:huggingface/o/m@1", "revision": "r"})
    assert view["downloadLocation"] == "https://huggingface.co/o/m/resolve/r/m.safetensors"
    for nothing in (None, ""):
        with pytest.raises(P.InvalidStatement, match="no revision"):
            P.identity_view({"files": [{"name": "m.safetensors", "digest": {}}], "uri": "pkg:huggingface/o/m@1", "revision": nothing})
