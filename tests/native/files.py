"""Makes small tensor files, and tools that derive one from another by a pure function of their inputs."""

import hashlib
import os
import stat
import struct
import sys

import numpy as np

CODES = {"F32": 0, "F16": 1, "Q8_0": 8, "Q4_K": 12, "Q6_K": 14}


def _text(s):
    b = s.encode()
    return struct.pack("<Q", len(b)) + b


def write_gguf(path, values, tensors, alignment=32, version=3):
    """values: name to string, integer or (type code, bytes); tensors: (name, dims, type code, bytes)."""
    out = struct.pack("<IIQQ", 0x46554747, version, len(tensors), len(values))
    for k, v in values.items():
        out += _text(k) + (struct.pack("<I", v[0]) + v[1] if isinstance(v, tuple) else struct.pack("<I", 8) + _text(v) if isinstance(v, str) else struct.pack("<II", 4, v))
    offset, payload = 0, b""
    for name, dims, code, data in tensors:
        out += _text(name) + struct.pack("<I", len(dims)) + struct.pack(f"<{len(dims)}Q", *dims) + struct.pack("<iQ", code, len(payload))
        payload += data + b"\0" * (-len(data) % alignment)
    out += b"\0" * (-len(out) % alignment)
    with open(path, "wb") as f:
        f.write(out + payload)


def model(path, seed=7, name="tiny", vocab=64, embd=32, layers=1, kind="F16", extra=None):
    rng = np.random.default_rng(seed)
    shapes = [("token_embd.weight", (embd, vocab))]
    for i in range(layers):
        shapes += [(f"blk.{i}.{n}.weight", (embd,) if "norm" in n else (embd, embd)) for n in ("attn_norm", "attn_q", "attn_k", "attn_v", "attn_output", "ffn_norm", "ffn_gate", "ffn_up", "ffn_down")]
    shapes += [("output_norm.weight", (embd,)), ("output.weight", (embd, vocab))]
    tensors = [(n, d, CODES["F32"] if len(d) == 1 else CODES[kind], rng.bytes(int(np.prod(d)) * 2)) for n, d in shapes]
    write_gguf(path, {"general.name": name, **(extra or {})}, tensors)
    return path


TOOL = '''#!%(python)s
import hashlib, sys
sys.path[:0] = [%(root)r, %(here)r]
from files import CODES, write_gguf
from weftline.sources.layouts import parse_layout
args, options = sys.argv[1:], {}
if args == ["--help"]:
    print("build: 1234 (abc)"); sys.exit(0)
while args and args[0].startswith("--"):
    options[args[0]] = args[1]; args = args[2:]
source, out, qtype = args
blocks = {"Q8_0": "Q8_0", "Q4_K_M": "Q4_K", "Q4_K_S": "Q4_K", "Q6_K": "Q6_K"}
if qtype not in blocks:
    print("unknown type", qtype); sys.exit(3)
layout = parse_layout(source)
data = open(source, "rb").read()
matrix = open(options["--imatrix"], "rb").read() if "--imatrix" in options else b""
values = {"general.name": data[layout["kv_string_locs"]["general.name"]["off"]:][:layout["kv_string_locs"]["general.name"]["len"]].decode()}
if matrix:
    values["quantize.imatrix.file"] = options["--imatrix"]
tensors, ends = [], [t["rel_offset"] for t in layout["tensors"][1:]] + [layout["data_size"]]
for t, end in zip(layout["tensors"], ends):
    body = data[layout["data_start"] + t["rel_offset"]:layout["data_start"] + end]
    code, size = t["ggml_type"], len(body)
    if len(t["dims"]) > 1:
        kind = blocks[qtype]
        kind = options.get("--token-embedding-type", kind).upper() if t["name"] == "token_embd.weight" else kind
        kind = options.get("--output-tensor-type", kind).upper() if t["name"] == "output.weight" else kind
        code, size = CODES[kind], max(32, len(body) // 4)
        body = hashlib.shake_256(body + qtype.encode() + kind.encode() + matrix + %(salt)r).digest(size)
    tensors.append((t["name"], t["dims"], code, body))
write_gguf(out, values, tensors)
'''

CONVERTER = '''import hashlib, os, sys
sys.path[:0] = [%(root)r, %(here)r]
from files import model
args = sys.argv[1:]
name = args[args.index("--model-name") + 1] if "--model-name" in args else None
out, folder = args[args.index("--outfile") + 1], args[-1]
fold = hashlib.sha256(os.path.basename(folder).encode())
for n in sorted(os.listdir(folder)):
    if not n.startswith("."):
        fold.update(n.encode() + open(os.path.join(folder, n), "rb").read())
model(out, seed=int.from_bytes(fold.digest()[:4], "little"), name=name or os.path.basename(folder))
'''


def _fill(text, salt=b""):
    here = os.path.dirname(os.path.abspath(__file__))
    return text % {"python": sys.executable, "root": os.path.dirname(os.path.dirname(here)), "here": here, "salt": salt}


def tool(path, salt=b""):
    with open(path, "w") as f:
        f.write(_fill(TOOL, salt))
    os.chmod(path, os.stat(path).st_mode | stat.S_IXUSR)
    return str(path)


def converter(path):
    with open(path, "w") as f:
        f.write(_fill(CONVERTER))
    return str(path)


def flip(path, places):
    """Flips payload bytes, header untouched."""
    from weftline.sources.layouts import parse_layout

    start = parse_layout(str(path))["data_start"]
    data = bytearray(open(path, "rb").read())
    for p in places:
        data[start + p] ^= 0xFF
    open(path, "wb").write(data)


def sha(path):
    return hashlib.sha256(open(path, "rb").read()).hexdigest()
