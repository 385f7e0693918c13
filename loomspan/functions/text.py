"""Text functions on columns: tokens, identifier parts, hashed vectors, family names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that retrieval leaves out.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
VECTOR = 256


def words(text: Column) -> Column:
    """Letters, digits and underscores of any script, lower-cased; single characters and stop words are left out."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*STOP))


def han_pairs(text: Column) -> Column:
    """Overlapping pairs of characters of each run of Han characters; a run of one is itself."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{IsHan}]+"), F.lit(0))

    def pairs(run: Column) -> Column:
        return F.when(F.length(run) < 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, 2)))

    return F.flatten(F.transform(runs, pairs))


def identifier_parts(name: Column) -> Column:
    """Pieces of an identifier cut at case changes, digits and separators, lower-cased."""
    return F.transform(F.regexp_extract_all(name, F.lit("[A-Z]+(?![a-z])|[A-Z][a-z]*|[a-z]+|[0-9]+"), F.lit(0)), F.lower)


def vector_cell(token: Column) -> tuple[Column, Column]:
    """The dimension and sign of a token in hashed vectors: the md5's first four bytes modulo VECTOR, and the lowest bit of the fifth."""
    digest = F.md5(token)
    dim = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % VECTOR
    odd = F.conv(F.substring(digest, 9, 2), 16, 10).cast("long") % 2
    return dim, F.when(odd == 1, F.lit(1.0)).otherwise(F.lit(-1.0))


def split_ref(ref: Column) -> tuple[Column, Column]:
    """rel and name of "rel:name", cut at the last colon; without one all is the name."""
    name = F.substring_index(ref, ":", -1)
    return F.when(F.instr(ref, ":") > 0, F.left(ref, F.length(ref) - F.length(name) - 1)).otherwise(F.lit("")), name


def library_family(name: Column) -> Column:
    """A library's name without folder, "lib" in front, version and file suffix, lower-cased."""
    base = F.lower(F.regexp_replace(name, r"^.*[/\\]", ""))
    base = F.regexp_replace(base, r"\.framework$|\.so(\.[0-9]+)*$|(\.[0-9]+)*\.dylib$|\.dll$|\.lib$|\.a$", "")
    return F.regexp_replace(F.regexp_replace(base, r"^lib", ""), r"[-_.]?[0-9]+(\.[0-9]+)*$", "")


def candidate_names(family: Column) -> Column:
    """File names under which a library may be found."""
    return F.array(F.concat(F.lit("lib"), family, F.lit(".so")), F.concat(F.lit("lib"), family, F.lit(".dylib")), F.concat(family, F.lit(".dll")), F.concat(family, F.lit(".lib")), family)


def intent(question: Column) -> Column:
    """The first of a ladder of question kinds that fits."""
    q = F.lower(question)
    return (
        F.when(q.rlike(r"who calls|callers? of|called by"), "callers")
        .when(q.rlike(r"what does .* call|callees? of|calls to"), "callees")
        .when(q.rlike(r"risk|danger|hot ?spot|priority"), "risk")
        .when(q.rlike(r"explain|what is|how does"), "explain")
        .otherwise("retrieve")
    )


def demangled(name: Column) -> Column:
    """The readable part of an Itanium mangled name: its length-prefixed parts joined by "::", and "<...>" for template arguments.

    A nested name ends at its E. What can't be read is "", as is any other name; the caller keeps the name that it has.
    """
    digits = lambda rest: F.regexp_extract(rest, r"^[0-9]+", 0)
    nested = F.startswith(name, F.lit("_ZN"))
    rest = F.substring(name, F.when(nested, 4).otherwise(3), F.length(name))
    start = F.struct(rest.alias("rest"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, _: Column) -> Column:
        d = digits(state["rest"])
        n = d.try_cast("int")
        fits = (n > 0) & (F.length(state["rest"]) >= F.length(d) + n)
        part = F.substring(state["rest"], F.length(d) + 1, n)
        after = F.substring(state["rest"], F.length(d) + n + 1, F.length(state["rest"]))
        return F.when(fits, F.struct(after.alias("rest"), F.array_append(state["parts"], part).alias("parts"))).otherwise(state)

    def end(state: Column) -> Column:
        left = F.when(nested & F.startswith(state["rest"], F.lit("E")), F.substring(state["rest"], 2, F.length(state["rest"]))).otherwise(state["rest"])
        tail = F.when(F.startswith(left, F.lit("I")), "<...>").otherwise("")
        return F.when(F.size(state["parts"]) > 0, F.concat(F.array_join(state["parts"], "::"), tail)).otherwise("")

    read = F.aggregate(F.regexp_extract_all(rest, F.lit("[0-9]+"), F.lit(0)), start, step, end)
    return F.when(F.startswith(name, F.lit("_Z")), F.coalesce(read, F.lit(""))).otherwise("")
