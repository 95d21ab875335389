"""A stand-in for quantising and converting programs, with the standard library alone: outputs are pure functions of the inputs.

Run as a program it takes the arguments that those take; as a module it writes small tensor files.
"""

from __future__ import annotations

import hashlib
import os
import struct
import sys

# The public container's magic number, and its codes of the tensor types used here.
MAGIC = 0x46554747
CODES = {"F32": 0, "F16": 1, "Q8_0": 8, "Q4_K": 12, "Q6_K": 14}
BLOCKS = {"Q8_0": "Q8_0", "Q4_K_M": "Q4_K", "Q6_K": "Q6_K"}


def _text(s: str) -> bytes:
    return struct.pack("<Q", len(s.encode())) + s.encode()


def write_tensors(path: str, strings: dict, tensors: list, alignment: int = 32) -> None:
    """tensors: (name, dims, type code, bytes), laid out one after another."""
    head = struct.pack("<IIQQ", MAGIC, 3, len(tensors), len(strings) + (alignment != 32))
    for key, value in strings.items():
        head += _text(key) + struct.pack("<I", 8) + _text(value)
    if alignment != 32:
        head += _text("general.alignment") + struct.pack("<II", 4, alignment)
    body = b""
    for name, dims, code, data in tensors:
        head += _text(name) + struct.pack(f"<I{len(dims)}QiQ", len(dims), *dims, code, len(body))
        body += data + bytes(-len(data) % alignment)
    with open(path, "wb") as file:
        file.write(head + bytes(-len(head) % alignment) + body)


def read_tensors(path: str) -> tuple[dict, list]:
    """(strings, tensors) of a file that write_tensors wrote with the usual alignment."""
    with open(path, "rb") as file:
        data = file.read()
    at = 0

    def take(form: str) -> tuple:
        nonlocal at
        at += struct.calcsize(form)
        return struct.unpack_from(form, data, at - struct.calcsize(form))

    def word() -> str:
        nonlocal at
        (n,) = take("<Q")
        at += n
        return data[at - n : at].decode()

    _, _, n_tensors, n_strings = take("<IIQQ")
    strings = {}
    for _ in range(n_strings):
        key = word()
        take("<I")
        strings[key] = word()
    table = []
    for _ in range(n_tensors):
        name = word()
        (n,) = take("<I")
        table.append((name, *take(f"<{n}Q"), *take("<iQ")))
    start, ends = at + -at % 32, [t[-1] for t in table[1:]]
    return strings, [(t[0], t[1:-2], t[-2], data[start + t[-1] : start + end]) for t, end in zip(table, [*ends, len(data) - start])]


def model(path: str, name: str, seed: str, embd: int = 32, vocab: int = 64) -> str:
    """A small source file of float tensors whose bytes follow from the seed."""
    shapes = [("token_embd.weight", (embd, vocab)), ("blk.0.attn_norm.weight", (embd,)), ("blk.0.attn_q.weight", (embd, embd)), ("output_norm.weight", (embd,)), ("output.weight", (embd, vocab))]
    tensors = []
    for tensor, dims in shapes:
        n = 4 * dims[0] if len(dims) == 1 else 2 * dims[0] * dims[1]
        tensors.append((tensor, dims, CODES["F32" if len(dims) == 1 else "F16"], hashlib.shake_256(f"{seed} {tensor}".encode()).digest(n)))
    write_tensors(path, {"general.name": name}, tensors)
    return path


def derive(source: str, out: str, qtype: str, matrix: str | None = None, embedding: str | None = None, output: str | None = None) -> None:
    strings, tensors = read_tensors(source)
    salt = b""
    if matrix:
        strings["quantize.imatrix.file"] = matrix
        with open(matrix, "rb") as file:
            salt = file.read()
    made = []
    for name, dims, code, body in tensors:
        if len(dims) > 1:
            kind = ({"token_embd.weight": embedding, "output.weight": output}.get(name) or BLOCKS[qtype]).upper()
            code, body = CODES[kind], hashlib.shake_256(body + f"{qtype} {kind}".encode() + salt).digest(len(body) // 4)
        made.append((name, dims, code, body))
    write_tensors(out, strings, made)


def convert(folder: str, out: str, name: str | None) -> None:
    fold = hashlib.sha256(os.path.basename(folder).encode())
    for file in sorted(os.listdir(folder)):
        if not file.startswith("."):
            with open(os.path.join(folder, file), "rb") as data:
                fold.update(file.encode() + data.read())
    model(out, name or os.path.basename(folder), fold.hexdigest())


def main(args: list[str]) -> int:
    if args == ["--help"]:
        print("build: 1 (sample)")
        return 0
    options = {}
    while args and args[0].startswith("--"):
        options[args[0]], args = args[1], args[2:]
    if "--outfile" in options:
        convert(args[0], options["--outfile"], options.get("--model-name"))
    elif len(args) != 3 or args[2] not in BLOCKS:
        print("unknown type", *args[2:])
        return 3
    else:
        derive(*args, options.get("--imatrix"), options.get("--token-embedding-type"), options.get("--output-tensor-type"))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
