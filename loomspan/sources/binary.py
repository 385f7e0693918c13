"""Executable containers as rows: ELF, PE and Mach-O, parsed from bytes by mapInArrow.

A report has the format, bits, symbols (name, kind: export, import or dynamic), dependencies (name, kind) and mitigations.
A mitigation is true, false or null; null means that it wasn't looked for, which is not false. Damaged files keep a status of their own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, format string, bits int, status string, symbols array<struct<name:string,kind:string>>, deps array<struct<name:string,kind:string>>, mitigations struct<pie:boolean,nx:boolean,relro:boolean,canary:boolean>"
_NONE = {"pie": None, "nx": None, "relro": None, "canary": None}


def sniff(data: bytes) -> str:
    if data[:4] == b"\x7fELF":
        return "elf"
    if data[:2] == b"MZ":
        return "pe"
    if data[:4] in (b"\xfe\xed\xfa\xce", b"\xfe\xed\xfa\xcf", b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe"):
        return "macho"
    return "fat" if data[:4] == b"\xca\xfe\xba\xbe" else "unknown"


def _text(data: bytes, at: int) -> str:
    end = data.find(b"\0", at)
    return data[at : end if end >= 0 else len(data)].decode("utf-8", "replace")


def parse_elf(data: bytes) -> dict:
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    kind = struct.unpack_from(order + "H", data, 16)[0]
    phoff, shoff = struct.unpack_from(order + ("QQ" if wide else "II"), data, 32 if wide else 28)
    phsize, phnum, shsize, shnum, _ = struct.unpack_from(order + "HHHHH", data, 54 if wide else 42)
    sections = []
    for i in range(shnum):
        f = struct.unpack_from(order + ("IIQQQQIIQQ" if wide else "IIIIIIIIII"), data, shoff + i * shsize)
        sections.append({"type": f[1], "offset": f[4], "size": f[5], "link": f[6], "entry": f[9]})
    headers = [struct.unpack_from(order + ("IIQQQQQQ" if wide else "IIIIIIII"), data, phoff + i * phsize) for i in range(phnum)]
    symbols, deps, now = [], [], False
    for s in sections:
        if s["type"] == 11 and s["entry"]:  # dynamic symbols
            names = sections[s["link"]]["offset"]
            for at in range(s["offset"] + s["entry"], s["offset"] + s["size"], s["entry"]):
                name, info, where = (lambda f: (f[0], f[1], f[3]) if wide else (f[0], f[3], f[5]))(struct.unpack_from(order + ("IBBHQQ" if wide else "IIIBBH"), data, at))
                if text := _text(data, names + name):
                    symbols.append({"name": text, "kind": "import" if where == 0 else "export" if info & 15 == 2 else "dynamic"})
        elif s["type"] == 6 and s["entry"]:  # the dynamic table
            names = sections[s["link"]]["offset"]
            for at in range(s["offset"], s["offset"] + s["size"], s["entry"]):
                tag, value = struct.unpack_from(order + ("qQ" if wide else "iI"), data, at)
                if tag in (1, 14, 15, 29):
                    deps.append({"name": _text(data, names + value), "kind": {1: "needed", 14: "id", 15: "rpath", 29: "runpath"}[tag]})
                now |= tag == 24 or (tag == 30 and bool(value & 8)) or (tag == 0x6FFFFFFB and bool(value & 1))
    stack = next((h for h in headers if h[0] == 0x6474E551), None)
    flags = stack[1 if wide else 6] if stack else None
    relro = any(h[0] == 0x6474E552 for h in headers)
    names = {s["name"] for s in symbols}
    return {"format": "elf", "bits": 64 if wide else 32, "symbols": symbols, "deps": deps, "mitigations": {"pie": kind == 3 if kind in (2, 3) else None, "nx": None if flags is None else not flags & 1, "relro": relro and now if headers else None, "canary": "__stack_chk_fail" in names if symbols else None}}


def parse_pe(data: bytes) -> dict:
    at = struct.unpack_from("<I", data, 60)[0]
    if data[at : at + 4] != b"PE\0\0":
        raise ValueError("no PE header")
    count, = struct.unpack_from("<H", data, at + 6)
    size, = struct.unpack_from("<H", data, at + 20)
    opt = at + 24
    wide = struct.unpack_from("<H", data, opt)[0] == 0x20B
    flags, = struct.unpack_from("<H", data, opt + 70)
    tables, = struct.unpack_from("<I", data, opt + (108 if wide else 92))
    dirs = [struct.unpack_from("<II", data, opt + (112 if wide else 96) + 8 * i) for i in range(min(tables, 16))]
    sections = [struct.unpack_from("<IIII", data, opt + size + 40 * i + 8) for i in range(count)]

    def offset(rva: int) -> int:
        for vsize, va, raw, ptr in sections:
            if va <= rva < va + max(vsize, raw):
                return ptr + rva - va
        raise ValueError(f"address {rva:x} is in no section")

    symbols, deps = [], []
    if len(dirs) > 0 and dirs[0][0]:
        base = offset(dirs[0][0])
        names, addresses = struct.unpack_from("<I", data, base + 24)[0], struct.unpack_from("<I", data, base + 32)[0]
        for i in range(names):
            symbols.append({"name": _text(data, offset(struct.unpack_from("<I", data, offset(addresses) + 4 * i)[0])), "kind": "export"})
    if len(dirs) > 1 and dirs[1][0]:
        base = offset(dirs[1][0])
        while any(entry := struct.unpack_from("<IIIII", data, base)):
            deps.append({"name": _text(data, offset(entry[3])), "kind": "needed"})
            look = offset(entry[0] or entry[4])
            step, top = (8, 1 << 63) if wide else (4, 1 << 31)
            while thunk := struct.unpack_from("<Q" if wide else "<I", data, look)[0]:
                if not thunk & top:
                    symbols.append({"name": _text(data, offset(thunk) + 2), "kind": "import"})
                look += step
            base += 20
    return {"format": "pe", "bits": 64 if wide else 32, "symbols": symbols, "deps": deps, "mitigations": {"pie": bool(flags & 0x40), "nx": bool(flags & 0x100), "relro": None, "canary": None}}


_DYLIBS = {0xC: "needed", 0xD: "id", 0x80000018: "weak", 0x8000001F: "reexport"}


def parse_macho(data: bytes) -> dict:
    order = "<" if data[:4] in (b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe") else ">"
    wide = data[:4] in (b"\xfe\xed\xfa\xcf", b"\xcf\xfa\xed\xfe")
    commands, = struct.unpack_from(order + "I", data, 16)
    flags, = struct.unpack_from(order + "I", data, 24)
    at, symbols, deps = 32 if wide else 28, [], []
    for _ in range(commands):
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 8:
            raise ValueError("a load command of no size")
        if kind in _DYLIBS or kind == 0x8000001C:
            deps.append({"name": _text(data[: at + size], at + struct.unpack_from(order + "I", data, at + 8)[0]), "kind": _DYLIBS.get(kind, "rpath")})
        elif kind == 2:
            table, n, names, _ = struct.unpack_from(order + "IIII", data, at + 8)
            for i in range(n):
                name, info = struct.unpack_from(order + "IB", data, table + i * (16 if wide else 12))
                if info & 0xE0 == 0 and info & 1 and (text := _text(data, names + name)):
                    symbols.append({"name": text, "kind": "import" if info & 0x0E == 0 else "export"})
        at += size
    canary = any(s["name"] == "___stack_chk_fail" for s in symbols) if symbols else None
    return {"format": "macho", "bits": 64 if wide else 32, "symbols": symbols, "deps": deps, "mitigations": {"pie": bool(flags & 0x200000), "nx": not flags & 0x20000, "relro": None, "canary": canary}}


def parse(data: bytes) -> dict:
    """The report of a file's bytes; of a fat Mach-O its first slice."""
    kind = sniff(data)
    empty = {"format": kind, "bits": None, "symbols": [], "deps": [], "mitigations": _NONE}
    if kind == "unknown":
        return empty | {"status": "unknown"}
    try:
        if kind == "fat":
            first, size = struct.unpack_from(">II", data, 16)
            return parse_macho(data[first : first + size]) | {"format": "fat", "status": "ok"}
        return {"elf": parse_elf, "pe": parse_pe, "macho": parse_macho}[kind](data) | {"status": "ok"}
    except (struct.error, IndexError, ValueError) as e:
        return empty | {"status": f"damaged: {e}"}


_PAIRS = pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string())]))
_ARROW = pa.schema([("path", pa.string()), ("format", pa.string()), ("bits", pa.int32()), ("status", pa.string()), ("symbols", _PAIRS), ("deps", _PAIRS), ("mitigations", pa.struct([(k, pa.bool_()) for k in _NONE]))])


def reports(files: DataFrame) -> DataFrame:
    """A report for each row of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([{"path": path} | parse(content or b"")], schema=_ARROW)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def symbols(df: DataFrame) -> DataFrame:
    return df.select("path", F.inline("symbols"))


def dependencies(df: DataFrame) -> DataFrame:
    return df.select("path", F.inline("deps"))
