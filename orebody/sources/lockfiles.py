"""Importers of lockfiles: rendered from dependencies, read back line by line, and compared with what packages declare.

A lockfile is a row (lock, text). Importers, their sections and dependencies are pieces of the array of its lines, cut where a line
begins one, so reading shuffles nothing. Entries of indented JSON go by running windows over numbered lines. No YAML is reformatted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The sections of an importer, in the order in which they are written.
SECTIONS = ("dependencies", "devDependencies", "optionalDependencies")
_IMPORTER = r"^ {2}([^\s].*?):(?: (.*))?$"
_SECTION = rf"^ {{4}}({'|'.join(SECTIONS)}):$"
_NAME = r"^ {6}(?:'([^']+)'|([^:]+)):\s*$"
_VALUE = r"^ {8}(specifier|version): (.*)$"
_ENTRY = r'^ {4}("(?:[^"\\]|\\.)*"): ([{\[])'


def _lines(locks: DataFrame) -> DataFrame:
    """(lock, line, text)."""
    return locks.select("lock", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def _last(when: Column, value: Column) -> Column:
    return F.last(F.when(when, value), ignorenulls=True).over(Window.partitionBy("lock").orderBy("line"))


def _pieces(lines: Column, begins: Callable[[Column], Column]) -> Column:
    """Array of (at, lines): the lines from each that begins a piece, ``at`` its index, up to the next one; lines before the first are left out."""
    at = F.filter(F.transform(lines, lambda x, i: F.when(begins(x), i)), lambda i: i.isNotNull())
    cut_up = lambda a: F.transform(a, lambda i, j: F.struct(i.alias("at"), F.slice(lines, i + 1, F.coalesce(F.get(a, j + 1), F.size(lines)) - i).alias("lines")))
    return F.transform(F.array(at), cut_up)[0]  # an array of one binds ``at``, which would be made again for each piece


def _importer(x: Column) -> Column:
    return x.rlike(_IMPORTER)


def _deeper(x: Column) -> Column:
    return x.rlike(r"^ {4}\S")


def _read(locks: DataFrame) -> DataFrame:
    """Importers of the first ``importers`` part: (lock, root, start, lines)."""
    all_ = F.split("text", "\n")
    top = locks.select("lock", all_.alias("all"), F.array_position(all_, "importers:").alias("top")).where("top > 0")
    after = top.select("lock", "top", F.slice("all", F.col("top").cast("int") + 1, F.size("all")).alias("after"))
    end = F.array_position(F.transform("after", lambda x: x.rlike(r"^\S")), True)
    part = after.select("lock", "top", F.when(end > 0, F.slice("after", F.lit(1), end.cast("int") - 1)).otherwise(F.col("after")).alias("part"))
    each = part.select("lock", "top", F.explode(_pieces(F.col("part"), _importer)).alias("x"))
    return each.select("lock", F.regexp_extract(F.col("x.lines")[0], _IMPORTER, 1).alias("root"), (F.col("top") + F.col("x.at")).cast("int").alias("start"), F.col("x.lines").alias("lines"))


def importers(locks: DataFrame) -> DataFrame:
    """(lock, root, start, lines, block_hash): the importers of each lockfile, where they start, how many lines they own, and the digest of these."""
    block = F.concat(F.array_join("lines", "\n"), F.lit("\n"))
    return _read(locks).select("lock", "root", "start", F.size("lines").cast("long").alias("lines"), F.sha2(block, 256).alias("block_hash"))


def dependencies(locks: DataFrame) -> DataFrame:
    """(lock, root, section, name, specifier, version) of every importer; values without the quotes around them. A name that a section of an importer has again is one row, with the greatest values."""
    value = lambda x: F.regexp_replace(F.regexp_extract(x, _VALUE, 2), "^['\"]|['\"]$", "")
    pick = lambda lines, k: F.array_max(F.transform(F.filter(lines, lambda x: F.regexp_extract(x, _VALUE, 1) == k), value)).alias(k)
    name = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, _NAME, 1), F.lit("")), F.regexp_extract(x, _NAME, 2))

    def entries(section: Column) -> Column:
        found = _pieces(section["lines"], lambda x: x.rlike(r"^ {6}\S"))
        return F.transform(found, lambda e: F.struct(F.regexp_extract(section["lines"][0], _SECTION, 1).alias("section"), name(e["lines"][0]).alias("name"), pick(e["lines"], "specifier"), pick(e["lines"], "version")))

    sections = _pieces(F.col("lines"), lambda x: _importer(x) | _deeper(x))
    rows = _read(locks).select("lock", "root", F.filter(F.flatten(F.transform(sections, entries)), lambda e: (e["section"] != "") & (e["name"] != "")).alias("found"))
    rows = rows.withColumn("keys", F.array_distinct(F.transform("found", lambda e: F.concat(e["section"], F.lit("\n"), e["name"]))))
    of = lambda k: F.filter("found", lambda e: F.concat(e["section"], F.lit("\n"), e["name"]) == k)
    most = lambda k, c: F.array_max(F.transform(of(k), lambda e: e[c])).alias(c)
    merged = F.transform("keys", lambda k: F.struct(F.substring_index(k, "\n", 1).alias("section"), F.substring_index(k, "\n", -1).alias("name"), most(k, "specifier"), most(k, "version")))
    once = F.when(F.size("keys") == F.size("found"), F.col("found")).otherwise(merged)
    return rows.select("lock", "root", F.explode(once).alias("e")).select("lock", "root", "e.*")


def faults(locks: DataFrame) -> DataFrame:
    """(lock, fault, subject): lockfiles without importers, and mappings in an importer that are none of SECTIONS (edits of such are refused)."""
    none = locks.join(_lines(locks).where("text = 'importers:'").select("lock"), "lock", "left_anti").select("lock", F.lit("no-importers").alias("fault"), F.lit(None).cast("string").alias("subject"))
    odd = _read(locks).select("lock", F.explode("lines").alias("text")).where(_deeper(F.col("text")) & ~F.col("text").rlike(_SECTION))
    return none.union(odd.select("lock", F.lit("unfamiliar-mapping"), F.trim("text")))


def rendered(roots: DataFrame, declared: DataFrame) -> DataFrame:
    """(lock, text) of importers (lock, root) and their dependencies (lock, root, section, name, specifier, version): roots, sections and names in order; an importer without any is ``{}``."""
    quoted = F.when(F.col("name").startswith("@"), F.concat(F.lit("'"), "name", F.lit("'"))).otherwise(F.col("name"))
    scalar = lambda c: F.when(F.col(c).endswith(":"), F.concat(F.lit("'"), c, F.lit("'"))).otherwise(F.col(c))
    entry = F.concat(F.lit("      "), quoted, F.lit(":\n        specifier: "), scalar("specifier"), F.lit("\n        version: "), scalar("version"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x["text"])
    place = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    # One shuffle, by lockfile: sections, importers and files are then grouped where they lie.
    own = declared.where("lock IS NOT NULL AND root IS NOT NULL").select("lock", "root", place.alias("at"), "section", "name", entry.alias("text"), F.lit(False).alias("given"))
    no = lambda kind: F.lit(None).cast(kind)
    given = roots.select("lock", "root", no("long").alias("at"), no("string").alias("section"), no("string").alias("name"), no("string").alias("text"), F.lit(True).alias("given"))
    part = own.union(given).repartition("lock").groupBy("lock", "root", "given", "at", "section").agg(F.array_join(ordered(["name", "text"]), "\n").alias("text"))
    part = part.select("lock", "root", "given", "at", F.when(~F.col("given"), F.concat(F.lit("    "), "section", F.lit(":\n"), "text")).alias("text"))
    body = part.groupBy("lock", "root").agg(F.bool_or("given").alias("given"), F.count_if(~F.col("given")).alias("n"), F.array_join(ordered(["at", "text"]), "\n").alias("text")).where("given")
    whole = body.select("lock", "root", F.concat(F.lit("  "), "root", F.when(F.col("n") == 0, ": {}\n").otherwise(F.concat(F.lit(":\n"), "text", F.lit("\n")))).alias("text"))
    return whole.groupBy("lock").agg(F.concat(F.lit("lockfileVersion: '9.0'\n\nimporters:\n\n"), F.array_join(ordered(["root", "text"]), "\n"), F.lit("\npackages:\n\n  end:\n    resolution: {}\n")).alias("text"))


def compared(roots: DataFrame, declared: DataFrame, locks: DataFrame) -> DataFrame:
    """(lock, root, section, name, fault) where packages (lock, root) and their dependencies don't agree with the lockfile.

    ``no-importer`` (section and name null; its dependencies aren't listed), ``missing`` in the lockfile,
    ``undeclared`` in the package, or ``differs`` in specifier or version. Only importers of given roots are looked at.
    """
    own = roots.select("lock", "root").distinct()
    there = importers(locks).select("lock", "root").distinct()
    none = own.join(there, ["lock", "root"], "left_anti").select("lock", "root", F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("name"), F.lit("no-importer").alias("fault"))
    both = own.join(there, ["lock", "root"], "left_semi")
    key = ["lock", "root", "section", "name"]
    a = declared.join(both, ["lock", "root"], "left_semi").select(*key, F.struct("specifier", "version").alias("want"), F.lit(True).alias("a"))
    b = dependencies(locks).join(both, ["lock", "root"], "left_semi").select(*key, F.struct("specifier", "version").alias("got"), F.lit(True).alias("b"))
    j = a.join(b, key, "full_outer")
    fault = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "undeclared").when(~F.col("want").eqNullSafe(F.col("got")), "differs")
    return j.select(*key, fault.alias("fault")).where("fault IS NOT NULL").union(none)


def json_entries(locks: DataFrame) -> DataFrame:
    """(lock, section, key, start, lines) of lockfiles in indented JSON: the entries of ``workspaces`` and ``packages``, with the lines they own up to the next one, blank ones left out."""
    t = F.col("text")
    head = t.rlike(r'^ {2}"(workspaces|packages)": \{$')
    rows = _lines(locks).withColumn("section", _last(head | t.rlike(r"^ {2}\S"), F.regexp_extract(t, r'^ {2}"(workspaces|packages)": \{$', 1)))
    rows = rows.where((F.col("section") != "") & ~head)
    rows = rows.withColumn("start", _last(t.rlike(_ENTRY), F.col("line"))).where("start IS NOT NULL").withColumn("key", _last(t.rlike(_ENTRY), F.regexp_extract(t, _ENTRY, 1)))
    own = rows.where((F.trim("text") != "") & t.rlike(r"^ {4}"))
    return own.groupBy("lock", "section", "start", "key").agg(F.count(F.lit(1)).alias("lines")).select("lock", "section", F.from_json(F.concat(F.lit('{"k":'), "key", F.lit("}")), "k string")["k"].alias("key"), "start", "lines")
