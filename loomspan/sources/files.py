"""Sources and sinks: folders of text, JSON snapshots in their variants, build scripts, graph and alert formats."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a text format takes; beyond it the sink refuses rather than gathers without bound.
TEXT_ROWS = 100_000


def scan(spark: SparkSession, root: str, glob: str = "*", exclude: str | None = None) -> DataFrame:
    """path, name, size, mtime, content of files below root; exclude is a regex on the path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    df = df.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    return df.where(~F.col("path").rlike(exclude)) if exclude else df


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 where they are valid, else Latin-1; a byte order mark is left out."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.regexp_replace(F.coalesce(utf8, F.decode(content, "ISO-8859-1")), "^\ufeff", "")


def texts(spark: SparkSession, root: str, glob: str = "*", exclude: str | None = None) -> DataFrame:
    return scan(spark, root, glob, exclude).select("path", decoded(F.col("content")).alias("text"))


#: The three shapes of unresolved names in snapshots: objects, rows and bare names.
SNAPSHOT = "files array<struct<rel:string,functions:array<struct<name:string,line:int,complexity:int>>>>, edges array<struct<caller:string,callee:string,line:int>>, unresolved array<string>"


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file; a malformed one is an error, not an empty result."""
    return spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def unresolved_names(snapshots: DataFrame) -> DataFrame:
    """callee of each unresolved entry, whichever shape it has: {"callee": ...}, ["callee", ...] or "callee"."""
    x = snapshots.select(F.explode("unresolved").alias("u"))
    name = F.when(F.startswith(F.ltrim("u"), F.lit("{")), F.coalesce(F.get_json_object("u", "$.callee"), F.get_json_object("u", "$.name"))).when(F.startswith(F.ltrim("u"), F.lit("[")), F.get_json_object("u", "$[0]")).otherwise(F.col("u"))
    return x.select(name.alias("callee")).where("callee is not null")


def build_dependencies(files: DataFrame) -> DataFrame:
    """path, name, how from build scripts (path, text): -l flags, and target_link_libraries or find_package calls. Comments don't count."""
    code = F.regexp_replace("text", r"(?m)#.*$", "")
    flags = F.transform(F.regexp_extract_all(code, F.lit(r"(?<![\w-])-l([A-Za-z0-9_+.-]+)"), F.lit(1)), lambda n: F.struct(n.alias("name"), F.lit("flag").alias("how")))
    packages = F.transform(F.regexp_extract_all(code, F.lit(r"(?i)find_package\s*\(\s*([A-Za-z0-9_+.-]+)"), F.lit(1)), lambda n: F.struct(n.alias("name"), F.lit("package").alias("how")))
    calls = F.regexp_extract_all(code, F.lit(r"(?i)target_link_libraries\s*\(([^)]*)\)"), F.lit(1))
    words = F.flatten(F.transform(calls, lambda c: F.slice(F.regexp_extract_all(c, F.lit(r"[^\s;]+"), F.lit(0)), 2, 1000)))
    linked = F.transform(F.filter(words, lambda w: ~w.isin("PUBLIC", "PRIVATE", "INTERFACE") & ~w.startswith("-") & ~w.startswith("$")), lambda n: F.struct(n.alias("name"), F.lit("linked").alias("how")))
    return files.select("path", F.explode(F.concat(flags, packages, linked)).alias("d")).select("path", "d.name", "d.how").distinct()


_DYNAMIC = {
    "c": r"\b(dlopen|LoadLibrary[AW]?)\s*\(\s*L?\"([^\"]+)\"",
    "py": r"\b(CDLL|LoadLibrary|WinDLL|cdll\.LoadLibrary)\s*\(\s*['\"]([^'\"]+)['\"]",
    "js": r"\b(ffi\.Library|dlopen|require)\s*\(\s*['\"]([^'\"]+\.(?:so|dll|dylib|node))['\"]",
    "matlab": r"\b(loadlibrary)\s*\(\s*['\"]([^'\"]+)['\"]",
}
_COMMENT = {"c": r"(?s)/\*.*?\*/|//[^\n]*", "js": r"(?s)/\*.*?\*/|//[^\n]*", "py": r"#[^\n]*", "matlab": r"%[^\n]*"}


def dynamic_libraries(files: DataFrame, lang: str) -> DataFrame:
    """path, api, library for calls that load a library by name, outside comments (files: path, text)."""
    code = files.where(F.col("text").rlike(_DYNAMIC[lang])).withColumn("code", F.regexp_replace("text", _COMMENT[lang], ""))
    apis, libs = F.regexp_extract_all("code", F.lit(_DYNAMIC[lang]), F.lit(1)), F.regexp_extract_all("code", F.lit(_DYNAMIC[lang]), F.lit(2))
    return code.select("path", F.inline(F.arrays_zip(apis.alias("api"), libs.alias("library"))))


def overwrite_files(table: DataFrame, path: str, key: str = "file_id") -> None:
    """Replace the partitions of the files that table has; others stay."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def _bounded(df: DataFrame) -> list:
    rows = df.limit(TEXT_ROWS + 1).collect()
    if len(rows) > TEXT_ROWS:
        raise ValueError(f"more than {TEXT_ROWS} rows; write a table or take a bounded projection")
    return rows


def to_dot(edges: DataFrame, name: str = "g") -> str:
    q = lambda x: json.dumps(str(x))
    return "\n".join([f"digraph {q(name)} {{", *(f"  {q(r['src'])} -> {q(r['dst'])};" for r in _bounded(edges.select("src", "dst").distinct().orderBy("src", "dst"))), "}"]) + "\n"


def to_mermaid(edges: DataFrame) -> str:
    rows = _bounded(edges.select("src", "dst").distinct().orderBy("src", "dst"))
    names = {x: f"n{i}" for i, x in enumerate(sorted({str(v) for r in rows for v in r}))}
    label = lambda x: '"' + x.replace('"', "#quot;") + '"'
    return "\n".join(["graph LR", *(f"  {i}[{label(x)}]" for x, i in names.items()), *(f"  {names[str(r['src'])]} --> {names[str(r['dst'])]}" for r in rows)]) + "\n"


def to_sarif(alerts: DataFrame, tool: str = "loomspan") -> str:
    """alerts (rule, rel, line, msg, level) as a SARIF 2.1.0 log."""
    rows = _bounded(alerts.orderBy("rel", "line", "rule"))
    results = [{"ruleId": r["rule"], "level": r["level"], "message": {"text": r["msg"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["rel"]}, "region": {"startLine": max(1, r["line"] or 1)}}}]} for r in rows]
    rules = [{"id": x} for x in sorted({r["rule"] for r in rows})]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}]}, indent=1)


def from_sarif(spark: SparkSession, path: str) -> DataFrame:
    """rule, rel, line, msg, level of the results of SARIF logs."""
    schema = "runs array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:long>>>>>>>>"
    r = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode(F.flatten("runs.results")).alias("r"))
    at = F.get("r.locations", F.lit(0))["physicalLocation"]
    return r.select(F.col("r.ruleId").alias("rule"), at["artifactLocation"]["uri"].alias("rel"), at["region"]["startLine"].alias("line"), F.col("r.message.text").alias("msg"), F.col("r.level").alias("level"))


def to_markdown(df: DataFrame) -> str:
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = _bounded(df)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def listed_paths(files: DataFrame) -> DataFrame:
    """path, listed: the paths that project files (path, text) name in XML attributes and elements, or one on a line; each once."""
    attribute = F.regexp_extract_all("text", F.lit(r"(?:path|file|name|href|Include)\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    element = F.regexp_extract_all("text", F.lit(r"<(?:path|file|File|Path)>\s*([^<]+?)\s*</"), F.lit(1))
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", "")), lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~F.contains(x, F.lit("<")))
    return files.select("path", F.explode(F.array_distinct(F.concat(attribute, element, lines))).alias("listed"))


def to_doxygen(functions: DataFrame) -> dict[str, str]:
    """File name to text: an index and a document for each source file of functions (rel, name, args, line)."""
    x = lambda v: escape(str(v), {'"': "&quot;"})
    by: dict[str, list] = {}
    for r in _bounded(functions.orderBy("rel", "line", "name")):
        by.setdefault(r["rel"], []).append(r)
    ids = {rel: "file_" + hashlib.sha256(rel.encode()).hexdigest()[:16] for rel in by}
    head = '<?xml version="1.0" encoding="UTF-8"?>\n'
    out = {"index.xml": head + "<doxygenindex>" + "".join(f'<compound refid="{ids[rel]}" kind="file"><name>{x(rel)}</name></compound>' for rel in by) + "</doxygenindex>\n"}
    for rel, rows in by.items():
        members = "".join(f'<memberdef kind="function" id="{ids[rel]}_{i}"><name>{x(r["name"])}</name><argsstring>{x(r["args"] or "")}</argsstring><location file="{x(rel)}" line="{r["line"]}"/></memberdef>' for i, r in enumerate(rows))
        out[f"{ids[rel]}.xml"] = head + f'<doxygen><compounddef id="{ids[rel]}" kind="file"><compoundname>{x(rel)}</compoundname><sectiondef kind="func">{members}</sectiondef></compounddef></doxygen>\n'
    return out


def save_json(value: object, path: str) -> None:
    """A local JSON file that is either the old or the new one, whatever happens meanwhile."""
    fd, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, sort_keys=True)
    os.replace(name, path)
