"""Sources, sinks, programs and streams."""

from __future__ import annotations

import json
import struct
import sys
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from loomspan.operators import tensor as T
from loomspan.plans import program
from loomspan.sources import binary, files, gpu
from loomspan.streaming import incremental


def vec(*v):
    return T.tensor(F.array(*(F.lit(float(x)) for x in v)))


def run(spark, text, name, **args):
    r = program.run(spark.range(1), program.parse(text), name, **args).first()
    return r["status"], {k: (r[k]["data"] if r[k] else None) for k in r.asDict() if k not in ("id", "status")}


def test_branches_and_loops(spark):
    text = """
    version 3
    func: pick
    arg:v:f64:3
    arg:i:i64
    ret:r:f64:1
    if:i:gt:1
    op:OP-INDEX:r:v:i
    else
    op:OP-SUM:r:v
    end
    end
    func: total
    arg:v:f64:4
    ret:s:f64:1
    const:s:0
    op:OP-NUMEL:n:v
    for:k:1:n
    op:OP-INDEX:x:v:k
    if:x:lt:0
    break
    end
    op:OP-ADD:s:s:x
    end
    end
    func: halve
    arg:x:f64:1
    ret:x:f64:1
    ret:n:f64:1
    const:n:0
    while:x:gt:1
    setb:x:div:x:2
    setb:n:add:n:1
    end
    end
    func: twice
    arg:v:f64:3
    ret:a:f64:1
    ret:b:f64:1
    call:a:pick:v:2
    call2:q,b:halve:a
    end
    func: square
    ret:y:f64:4
    fill:y:4:0
    for:i:1:4
    setb:t:mul:i:i
    op:OP-SETIDX:y:t:i
    end
    end
    func: odd
    ret:y:f64:1
    unmapped:cell:c{1}
    end
    func: many
    ret:y:f64:1
    reject: varargin
    end
    """
    assert run(spark, text, "pick", v=vec(3, 4, 5), i=vec(2)) == ("ok", {"r": [4.0]})
    assert run(spark, text, "pick", v=vec(3, 4, 5), i=vec(1)) == ("ok", {"r": [12.0]})
    assert run(spark, text, "total", v=vec(1, 2, -1, 9)) == ("ok", {"s": [3.0]})
    assert run(spark, text, "halve", x=vec(8)) == ("ok", {"x": [1.0], "n": [3.0]})
    assert run(spark, text, "twice", v=vec(1, 8, 2)) == ("ok", {"a": [8.0], "b": [3.0]})
    assert run(spark, text, "square") == ("ok", {"y": [1.0, 4.0, 9.0, 16.0]})
    assert run(spark, text, "odd") == ("unmapped", {"y": None}) and run(spark, text, "many")[0] == "rejected"
    assert program.census(program.parse(text))["unmapped cell"] == 1


def test_rows_take_their_own_branches(spark):
    f = program.parse("func: f\narg:x:f64:1\nret:y:f64:1\nset:y:x\nif:x:lt:0\nop:OP-ABS:y:x\nend\nend")
    df = spark.createDataFrame([(-2.0,), (3.0,)], "v double")
    assert sorted(r["y"]["data"][0] for r in program.run(df, f, "f", x=T.scalar(F.col("v"))).collect()) == [2.0, 3.0]


@pytest.mark.parametrize("bad", ["func: f\nwhat:x", "op:OP-ADD:y:x:x", "func: f\nif:x:gt:1", "func: f\nelse"])
def test_unknown_lines_are_errors(bad):
    with pytest.raises(ValueError):
        program.parse(bad)


def test_folders_and_texts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes("é\n".encode())
    (tmp_path / "y.txt").write_bytes(b"\xe9")
    (tmp_path / "z.bin").write_bytes(b"\0")
    got = {r["path"].rpartition("/")[2]: r["text"] for r in files.texts(spark, str(tmp_path), "*.txt").collect()}
    assert got == {"x.txt": "é\n", "y.txt": "é"}
    assert files.texts(spark, str(tmp_path), "*.txt", exclude="/a/").count() == 1


def test_snapshots(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"files": [], "unresolved": [{"callee": "a"}, ["b", 3, "r"], "c"]}))
    assert sorted(r["callee"] for r in files.unresolved_names(files.read_snapshot(spark, str(p))).collect()) == ["a", "b", "c"]
    p.write_text("{")
    with pytest.raises(Exception):
        files.read_snapshot(spark, str(p)).collect()


def test_build_scripts_and_loaders(spark):
    f = spark.createDataFrame([("m", "LIBS = -lm -lfoo # -lno\n"), ("c", "find_package(Bar)\ntarget_link_libraries(app PUBLIC bar ${X} baz)")], "path string, text string")
    got = {(r["path"], r["name"], r["how"]) for r in files.build_dependencies(f).collect()}
    assert got == {("m", "m", "flag"), ("m", "foo", "flag"), ("c", "Bar", "package"), ("c", "bar", "linked"), ("c", "baz", "linked")}
    src = spark.createDataFrame([("a.c", 'dlopen("libq.so", 1); // dlopen("no.so")')], "path string, text string")
    assert [(r["api"], r["library"]) for r in files.dynamic_libraries(src, "c").collect()] == [("dlopen", "libq.so")]


def test_text_sinks(spark, tmp_path):
    e = spark.createDataFrame([("a", 'b"'), ("a", 'b"')], "src string, dst string")
    assert files.to_dot(e) == 'digraph "g" {\n  "a" -> "b\\"";\n}\n' and "n0 --> n1" in files.to_mermaid(e)
    alerts = spark.createDataFrame([("r", "f.c", 3, "m", "error"), ("s", "g.c", 1, "n", "note")], "rule string, rel string, line long, msg string, level string")
    p = tmp_path / "a.sarif"
    p.write_text(files.to_sarif(alerts))
    assert sorted(map(tuple, files.from_sarif(spark, str(p)).collect())) == sorted(map(tuple, alerts.collect()))
    assert files.to_markdown(alerts.limit(1)).count("\n") == 3
    files.save_json({"a": 1}, str(tmp_path / "j.json"))
    assert json.loads((tmp_path / "j.json").read_text()) == {"a": 1}
    t = spark.createDataFrame([(1, "a"), (2, "b")], "file_id int, v string")
    spark_path = str(tmp_path / "t")
    files.overwrite_files(t, spark_path)
    files.overwrite_files(spark.createDataFrame([(2, "c")], "file_id int, v string"), spark_path)
    assert sorted((r["file_id"], r["v"]) for r in spark.read.parquet(spark_path).collect()) == [(1, "a"), (2, "c")]


def pe_file():
    head = bytearray(0x400)
    head[:2], head[60:64] = b"MZ", struct.pack("<I", 0x80)
    head[0x80:0x84] = b"PE\0\0"
    struct.pack_into("<HH", head, 0x84, 0x8664, 1)
    struct.pack_into("<H", head, 0x94, 240)
    opt = 0x98
    struct.pack_into("<H", head, opt, 0x20B)
    struct.pack_into("<H", head, opt + 70, 0x140)
    struct.pack_into("<I", head, opt + 108, 16)
    struct.pack_into("<II", head, opt + 112, 0x1000, 40)
    struct.pack_into("<II", head, opt + 120, 0x1100, 40)
    struct.pack_into("<IIII", head, opt + 240 + 8, 0x400, 0x1000, 0x400, 0x400)
    body = bytearray(0x400)
    struct.pack_into("<I", body, 24, 1)
    struct.pack_into("<I", body, 32, 0x1040)
    struct.pack_into("<I", body, 0x40, 0x1050)
    body[0x50:0x54] = b"run\0"
    struct.pack_into("<IIIII", body, 0x100, 0x1180, 0, 0, 0x1160, 0x1180)
    body[0x160:0x168] = b"k32.dll\0"
    struct.pack_into("<QQ", body, 0x180, 0x11A0, 0)
    body[0x1A2:0x1A8] = b"Sleep\0"
    return bytes(head + body)


def macho_file():
    name = b"/usr/lib/libz.1.dylib\0".ljust(24, b"\0")
    dylib = struct.pack("<IIIIII", 0xC, 24 + len(name), 24, 0, 0, 0) + name
    strings = b"\0_main\0_puts\0"
    at = 32 + len(dylib) + 24
    table = struct.pack("<IBBHQ", 1, 0x0F, 1, 0, 0) + struct.pack("<IBBHQ", 7, 0x01, 0, 0, 0)
    symtab = struct.pack("<IIIIII", 2, 24, at, 2, at + len(table), len(strings))
    return struct.pack("<IIIIIIII", 0xFEEDFACF, 0x1000007, 3, 2, 2, len(dylib) + 24, 0x200000, 0) + dylib + symtab + table + strings


def test_binaries(spark):
    own = open(sys.executable, "rb").read()
    rows = [("elf", bytearray(own)), ("pe", bytearray(pe_file())), ("macho", bytearray(macho_file())), ("cut", bytearray(own[:80])), ("txt", bytearray(b"hello")), ("none", None)]
    df = binary.reports(spark.createDataFrame(rows, "path string, content binary")).cache()
    got = {r["path"]: r for r in df.collect()}
    assert got["elf"]["status"] == "ok" and got["elf"]["bits"] == 64 and any(d["kind"] == "needed" for d in got["elf"]["deps"])
    assert [tuple(s) for s in got["pe"]["symbols"]] == [("run", "export"), ("Sleep", "import")] and got["pe"]["deps"][0]["name"] == "k32.dll" and got["pe"]["mitigations"]["nx"]
    assert [tuple(s) for s in got["macho"]["symbols"]] == [("_main", "export"), ("_puts", "import")] and got["macho"]["mitigations"]["relro"] is None
    assert got["cut"]["status"].startswith("damaged") and got["txt"]["status"] == got["none"]["status"] == "unknown"
    assert binary.dependencies(df).where("path = 'macho'").first()["name"] == "/usr/lib/libz.1.dylib" and binary.symbols(df).count() > 2


def test_fingerprints_by_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "table")
    rows = [[("a", "1", 1), ("b", "1", 1), ("a", "2", 2)], [("a", "2", 3), ("c", "9", 3)]]
    for i, r in enumerate(rows):
        spark.createDataFrame(r, "path string, content string, ts long").coalesce(1).write.mode("append").parquet(src)
        q = incremental.keep_fingerprints(spark.readStream.schema("path string, content string, ts long").parquet(src), out, str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
        got = {r["path"]: r["version"] for r in incremental.read_table(spark, out, i).collect()}
    assert got == {"a": 0, "b": 0, "c": 1}


def test_event_windows(spark, tmp_path):
    spark.sql("select * from values (1, timestamp'2024-01-01 00:10:00', 'x', 2.0D), (1, timestamp'2024-01-01 00:10:00', 'x', 2.0D), (2, timestamp'2024-01-01 01:10:00', 'x', 3.0D) t(event_id, ts, event_type, value)").write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("event_id int, ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    for name, df, n in (("win", incremental.event_counts(s), 2), ("uniq", incremental.once(s), 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "win" else "append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == n


def test_python_sources_to_a_call_graph(spark):
    from loomspan.operators import graph
    from loomspan.sources import python_ast

    src = [("a.py", "def f(x):\n    if x and x > 1:\n        g(x)\n    return h()\n\nclass C:\n    def g(self):\n        return [f(i) for i in self.k()]\n"), ("b.py", "def g(): pass\n"), ("c.py", "def broken(:")]
    p = python_ast.parse(spark.createDataFrame(src, "path string, text string")).cache()
    assert {r["path"]: r["status"] for r in p.collect()} == {"a.py": "ok", "b.py": "ok", "c.py": "damaged: SyntaxError"}
    f = python_ast.functions(p)
    assert {(r["fkey"], r["complexity"]) for r in f.collect()} == {("a.py:f", 3), ("a.py:C.g", 2), ("b.py:g", 1)}
    edges, missing = graph.resolve(python_ast.call_sites(p), f)
    assert {(r["caller"], r["callee"]) for r in edges.collect()} == {("a.py:f", "a.py:C.g"), ("a.py:f", "b.py:g"), ("a.py:C.g", "a.py:f")}
    assert {r["callee"] for r in missing.collect()} == {"h", "k"}


def test_code_lines_made_alike(spark):
    from loomspan.operators.retrieval import cross_language_score, normalised_code

    df = spark.createDataFrame([("y = b + 1;",), ("y =  22 + b;",), ('puts("a")',), ("x = a - b",)], "v string")
    got = [r[0] for r in df.select(normalised_code(F.col("v"))).collect()]
    assert got[0] == got[1] and got[2] == "puts(S)" and got[3] == "x=a-b"
    assert df.select(cross_language_score(F.lit(1.0), F.lit(0.4), F.lit(0.0))).first()[0] == pytest.approx(0.7)


def elf_file(parts):
    """A small 64-bit ELF file with these sections (name, bytes)."""
    names, body, heads = b"\0", b"", [bytes(64)]
    for name, data in [*parts, (".shstrtab", None)]:
        at, names = len(names), names + name.encode() + b"\0"
        data = names if data is None else data
        heads.append(struct.pack("<IIQQQQIIQQ", at, 1, 0, 0, 64 + len(body), len(data), 0, 0, 1, 0))
        body += data
    ident = b"\x7fELF\x02\x01\x01" + bytes(9)
    return ident + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 0, 64 + len(body), 0, 64, 56, 0, 64, len(heads), len(heads) - 1) + body + b"".join(heads)


def test_device_code(spark):
    cubin = b"\x7fELF" + bytes(3) + b"\x33" + bytes(10) + struct.pack("<H", 190) + bytes(8)
    fat = gpu.FATBIN + cubin + b".text._ZN2ab5gemmXE\0.text._Z6kernelIfE\0" + b"\n.visible .entry plain ( .param\n.entry none;\n" + b"\x7fELF" + bytes(30)
    name = b"main_cs\0"
    spirv = struct.pack("<IIIII", gpu.SPIRV, 0x10000, 0, 9, 0) + struct.pack("<II", 2 << 16 | 17, 1) + struct.pack("<III", (3 + len(name) // 4) << 16 | 15, 5, 4) + name
    rows = [("cuda", elf_file([(".text", b"x"), (".nv_fatbin", fat), (".rodata", spirv)])), ("vulkan", elf_file([(".rodata", b"pad!" + spirv), (".data", gpu.FATBIN + bytes(9))])), ("empty", elf_file([(".hip_fatbin", bytes(50))])), ("none", elf_file([(".text", spirv)])), ("cut", elf_file([])[:70]), ("text", b"hello"), ("null", None)]
    out = gpu.device_code(spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary"))
    got = {(r["path"], r["section"]): r for r in out.collect()}
    assert set(got) == {("cuda", ".nv_fatbin"), ("vulkan", ".rodata"), ("vulkan", ".data"), ("empty", ".hip_fatbin"), ("cut", None)}
    cuda = got["cuda", ".nv_fatbin"]
    assert (cuda["backend"], cuda["status"], cuda["suspected"], cuda["confirmed"]) == ("cuda", "ok", 2, 1) and cuda["kernels"] == ["_Z6kernelIfE", "_ZN2ab5gemmXE", "plain"]
    assert got["vulkan", ".rodata"]["kernels"] == ["main_cs"] and got["vulkan", ".data"]["status"] == "unreadable" == got["empty", ".hip_fatbin"]["status"]
    assert got["cut", None]["status"].startswith("damaged")
    assert {(r["name"], r["readable"]) for r in gpu.kernels(out).collect()} == {("_ZN2ab5gemmXE", "ab::gemmX"), ("_Z6kernelIfE", "kernel<...>"), ("plain", ""), ("main_cs", "")}


def test_lists_of_files_and_xml(spark):
    text = '<proj><File path="src/a.m"/><path> b dir/c.m </path></proj>\n"src/d.m"\n# note\nsrc/a.m\r\n\n'
    got = files.listed_paths(spark.createDataFrame([("p", text), ("q", None), ("r", "")], "path string, text string")).collect()
    assert sorted(map(tuple, got)) == [("p", "b dir/c.m"), ("p", "src/a.m"), ("p", "src/d.m")]
    f = spark.createDataFrame([("a<b.c", "f", '(char *s = "x")', 3), ("a<b.c", "g", None, 9), ("z.c", "f", "()", 1)], "rel string, name string, args string, line int")
    out = files.to_doxygen(f)
    docs = {k: ElementTree.fromstring(v) for k, v in out.items()}
    listed = {c.get("refid"): c.find("name").text for c in docs["index.xml"]}
    assert sorted(listed.values()) == ["a<b.c", "z.c"] and {k for k in docs if k != "index.xml"} == {f"{i}.xml" for i in listed}
    first = next(docs[f"{i}.xml"] for i, n in listed.items() if n == "a<b.c")
    assert [(m.find("name").text, m.find("argsstring").text, m.find("location").get("line")) for m in first.iter("memberdef")] == [("f", '(char *s = "x")', "3"), ("g", None, "9")]
