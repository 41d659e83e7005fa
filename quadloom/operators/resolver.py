"""Sidecar lines to facts by what the vocabularies declare, and notes on the keys that they do not.

Every lookup is a frame, and few of its keys have most lines. A small one is broadcast, so that lines stay where they
are; a large one is joined by key and a salt, so that no key is one task's. None is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import split_values
from .emit import percent_encode, resolve_value

#: rows up to which a lookup is broadcast; shares that a key's lines are dealt into under a larger one
SMALL, SALTS = 100_000, 64

RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


@dataclass(frozen=True)
class Lookups:
    """declared: (kit, class, prop, iri, datatype, is_object), a row for each property of a class, inherited ones too.
    anywhere: (kit, prop, iri, datatype, is_object), properties without a domain. ranges: (iri, range) of object
    properties. kits: (kit, namespace). deprecated: (kit, prop, replacement). things: ranges that any thing fits."""

    declared: DataFrame
    anywhere: DataFrame
    ranges: DataFrame
    kits: DataFrame
    deprecated: DataFrame
    things: tuple[str, ...] = ()
    #: names of the lookups that are broadcast
    small: frozenset[str] = frozenset()

    def measured(self) -> Lookups:
        """With ``small`` filled in; frames made from rows of the driver have no size that Spark knows."""
        names = ("declared", "anywhere", "ranges", "kits", "deprecated")
        counts = reduce(DataFrame.unionAll, [getattr(self, n).limit(SMALL + 1).select(F.lit(n).alias("n")) for n in names]).groupBy("n").count()
        return replace(self, small=frozenset(names) - {r["n"] for r in counts.where(F.col("count") > SMALL).collect()})

    def left(self, rows: DataFrame, name: str, lookup: DataFrame, on: list[str]) -> DataFrame:
        """Rows (path, ...) left-joined with what is made of the lookup of that name."""
        if name in self.small:
            return rows.join(F.broadcast(lookup), on, "left")
        salted = lookup.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"], "left").drop("salt")


def _bracketed(c: Column) -> Column:
    return F.concat(F.lit("<"), c, F.lit(">"))


def _quoted(c: Column) -> Column:
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), c, F.lit('"'))


def _instances(namespace: Column) -> Column:
    """Where the things of a vocabulary live: its namespace without the ontology step."""
    return F.regexp_replace(namespace, "/ontology/", "/")


def _lines(lines: DataFrame, base: str, k: Lookups) -> DataFrame:
    """(path, line, subject, op, object, kit, class, prop, namespace): well-formed lines that have an object; a class
    that differs from a declared one in case alone is that one."""
    f = F.split("line", r" \| ", 3)
    rows = lines.where(F.size(f) == 3).select("path", "line", f[0].alias("subject"), f[1].alias("op"), f[2].alias("object")).where(F.trim("object") != "")
    key = F.split("subject", r"\.", 3)
    keyed = (F.size(key) == 3) & (F.col("op") != "linksTo")
    rows = rows.select("*", *(F.when(keyed, key[i]).alias(n) for i, n in enumerate(("kit", "given", "prop"))))
    names = k.declared.groupBy("kit", F.lower("class").alias("low")).agg(F.min("class").alias("least"), F.collect_set("class").alias("all"))
    rows = k.left(k.left(rows.withColumn("low", F.lower("given")), "declared", names, ["kit", "low"]), "kits", k.kits, ["kit"])
    cls = F.when(F.array_contains("all", F.col("given")), F.col("given")).otherwise(F.coalesce("least", "given"))
    home = F.coalesce("namespace", F.concat(F.lit(f"{base}ontology/"), "kit", F.lit("/")))
    return rows.select("path", "line", "subject", "op", "object", "kit", cls.alias("class"), "prop", F.when(F.col("kit").isNotNull(), home).alias("namespace"))


def _subjects(rows: DataFrame, base: str, k: Lookups) -> DataFrame:
    """(path, thing, of): each document's thing and the struct(kit, class) it is of. The first keyed line names the class;
    the address in its ``id`` wins over that, else the class's own id property counts if it is declared."""
    keyed = rows.where("kit IS NOT NULL AND op = 'hasValue'")
    first = keyed.groupBy("path").agg(F.min_by(F.struct("kit", "class", "namespace"), "line").alias("of"))
    own = F.concat(F.lower(F.substring("class", 1, 1)), F.expr("substring(class, 2)"), F.lit("Id"))
    address = F.trim("object")
    whole = (F.col("prop") == "id") & address.rlike("^<[^/<>]+/[^/<>]+/[^<>]+>$") & ~address.contains("://")
    plain = k.declared.select("kit", "class", "prop").distinct().withColumn("known", F.lit(True))
    ids = k.left(keyed.where((F.col("prop") == "id") | (F.col("prop") == own)), "declared", plain, ["kit", "class", "prop"])
    ids = ids.join(first, "path").where("kit = of.kit AND class = of.class").groupBy("path", "of").agg(
        F.min_by(F.when(whole, F.expr("substring(trim(object), 2, length(trim(object)) - 2)")), F.when(whole, F.col("line"))).alias("address"),
        F.min_by(address, F.when((F.col("prop") == own) & F.col("known"), F.col("line"))).alias("own"),
    )
    step = F.split("address", "/")
    thing = F.when(F.col("address").isNotNull(), _bracketed(F.concat(F.lit(base), percent_encode(F.col("address")))))
    thing = thing.when(F.col("own").isNotNull(), _bracketed(F.concat(_instances(F.col("of.namespace")), "of.class", F.lit("/"), percent_encode(F.col("own")))))
    of = F.when(F.col("address").isNotNull(), F.struct(step[0].alias("kit"), step[1].alias("class"))).otherwise(F.struct(F.col("of.kit").alias("kit"), F.col("of.class").alias("class")))
    return ids.select("path", thing.alias("thing"), of.alias("of")).where("thing IS NOT NULL")


def _declared(rows: DataFrame, k: Lookups) -> DataFrame:
    """Keyed rows with what is declared for them: (..., iri, datatype, is_object, known). An old date key is the new one
    where only the new one is declared."""
    new = F.when(F.col("prop") == "dateCreated", "createdDate").when(F.col("prop") == "dateUpdated", "updatedDate")
    has = k.declared.dropDuplicates(["kit", "class", "prop"])
    by_name = has.select("kit", "class", "prop", F.struct("iri", "datatype", "is_object").alias("mine"))
    renamed = has.where("prop IN ('createdDate', 'updatedDate')").select("kit", "class", F.col("prop").alias("new"), F.struct("iri", "datatype", "is_object").alias("other"))
    rows = k.left(rows.where("kit IS NOT NULL").withColumn("new", new), "declared", by_name, ["kit", "class", "prop"])
    rows = k.left(rows, "declared", renamed, ["kit", "class", "new"])
    moved = F.col("mine").isNull() & F.col("other").isNotNull()
    rows = rows.withColumns({"prop": F.when(moved, F.col("new")).otherwise(F.col("prop")), "d": F.coalesce("mine", "other")})
    free = k.anywhere.dropDuplicates(["kit", "prop"]).select("kit", "prop", F.struct("iri", "datatype", "is_object").alias("free"))
    rows = k.left(rows, "anywhere", free, ["kit", "prop"])
    return rows.withColumns(
        {
            "iri": F.coalesce("d.iri", "free.iri", F.concat("namespace", "prop")),
            "datatype": F.coalesce("d.datatype", "free.datatype"),
            "is_object": F.coalesce("d.is_object", F.lit(False)) | F.coalesce("free.is_object", F.lit(False)),
            "known": F.col("d").isNotNull() | F.col("free").isNotNull(),
        }
    ).drop("new", "mine", "other", "d", "free")


def _reference(base: str, things: tuple[str, ...]) -> Column:
    """struct(kind, value, error) of ``part`` under ``range``: any thing by its address, a class's thing by its id, else as a plain value resolves."""
    inner = F.trim(F.regexp_replace(F.trim("part"), "^<|>$", ""))
    is_address = F.trim("part").rlike("^<.*>$") & inner.contains("/") & ~inner.contains("://")

    def made(kind, value, error):
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(error).cast("string").alias("error"))

    none, any_thing = F.lit(None).cast("string"), F.col("range").isin(*things) if things else F.lit(False)
    of_class = F.concat(_instances(F.regexp_extract("range", "^(.*/)", 1)), F.regexp_extract("range", "([^/]*)$", 1), F.lit("/"), percent_encode(F.col("part")))
    return (
        F.when(any_thing & is_address, made("iri", F.concat(F.lit(base), percent_encode(inner)), None))
        .when(any_thing, made("error", none, "no address of a thing"))
        .when(F.col("range").rlike("/[^/]+$"), made("iri", of_class, None))
        .when(F.col("range").isNotNull(), made("error", none, "range is no class"))
        .otherwise(resolve_value(F.col("part"), base))
    )


def facts(lines: DataFrame, base: str, k: Lookups) -> DataFrame:
    """(path, s, p, o, error) of sidecar lines (path, line), each once; a row with an error has no fact, and no error stops another line.

    Links and plain keys are about the file; keyed lines are about the document's thing if they are of its class, else
    about the file. Malformed lines and those without an object give nothing; a path without keyed lines is a file alone.
    """
    k = k.measured()
    # all that belongs to a document is in one place, and no more of it than a share of the whole
    lines = lines.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    rows = _lines(lines, base, k)
    file = _bracketed(F.concat(F.lit(f"{base}File/"), percent_encode(F.col("path"))))
    null = F.lit(None).cast("string")
    wiki = (F.col("op") != "linksTo") & (F.col("object").contains("[[") | F.col("object").contains("]]"))
    subjects = _subjects(rows, base, k)
    rows, refused = rows.where(~wiki), rows.where(wiki)

    def out(df, s, p, o, error=null):
        return df.select("path", s.alias("s"), p.alias("p"), o.alias("o"), error.alias("error"))

    parts = [out(refused, null, null, null, F.lit("wiki link"))]
    to_file = _bracketed(F.concat(F.lit(f"{base}File/"), percent_encode(F.regexp_replace(F.col("value"), "^/", ""))))
    parts.append(out(rows.where("op = 'linksTo'").withColumn("value", F.col("object")), file, F.lit(f"<{base}md/linksTo>"), to_file))

    free = rows.where("op <> 'linksTo' AND kit IS NULL")
    link = F.col("subject").isin("md.externalLink", "md.unresolvedLink")
    parts.append(out(free.where(link), file, _bracketed(F.concat(F.lit(f"{base}md/"), F.expr("substring(subject, 4)"))), _quoted(F.col("object"))))
    # keys of old documents that end in -link or -links name files where their values look like paths
    many, one = F.col("subject").endswith("-links"), F.col("subject").endswith("-link")
    trimmed = F.transform(F.split("object", ","), lambda x: F.trim(x))
    values = F.when(many, F.filter(trimmed, lambda x: x != "")).when(one, F.array(F.trim("object"))).otherwise(F.array("object"))
    plain = free.where(~link).withColumn("value", F.explode(values))
    like_path = (many | one) & (F.col("value").contains("/") | F.col("value").endswith(".md"))
    key = _bracketed(F.concat(F.lit(f"{base}fm/"), percent_encode(F.col("subject"))))
    parts.append(out(plain, file, key, F.when(like_path, _bracketed(F.concat(F.lit(f"{base}File/"), percent_encode(F.col("value"))))).otherwise(_quoted(F.col("value")))))

    keyed = _declared(rows, k).join(subjects, "path", "left")
    about = F.when((F.col("of.kit") == F.col("kit")) & (F.col("of.class") == F.col("class")), F.col("thing")).otherwise(file)
    keyed = keyed.withColumn("about", F.coalesce(about, file))
    parts.append(out(keyed, F.col("about"), F.lit(RDF_TYPE), _bracketed(F.concat("namespace", "class"))))
    stated = keyed.where("NOT is_object")
    typed = F.when(F.col("datatype").isNull() | F.col("datatype").endswith("#string"), _quoted(F.col("object"))).otherwise(F.concat(_quoted(F.col("object")), F.lit("^^"), _bracketed(F.col("datatype"))))
    parts.append(out(stated, F.col("about"), _bracketed(F.col("iri")), typed))
    refs = k.left(keyed.where("is_object").withColumn("part", F.explode(split_values(F.col("object")))), "ranges", k.ranges.dropDuplicates(["iri"]), ["iri"])
    refs = refs.withColumn("r", _reference(base, k.things))
    value = F.when(F.col("r.kind") == "iri", _bracketed(F.col("r.value"))).when(F.col("r.kind") == "literal", _quoted(F.col("r.value")))
    good = value.isNotNull()
    parts.append(out(refs, F.when(good, F.col("about")), F.when(good, _bracketed(F.col("iri"))), value, F.col("r.error")))

    parts.append(out(lines.select("path").distinct(), file, F.lit(RDF_TYPE), F.lit(f"<{base}File>")))
    anchored = k.left(subjects.withColumn("kit", F.col("of.kit")), "kits", k.kits, ["kit"])
    home = F.coalesce("namespace", F.concat(F.lit(f"{base}ontology/"), "of.kit", F.lit("/")))
    parts.append(out(anchored, F.col("thing"), F.lit(RDF_TYPE), _bracketed(F.concat(home, "of.class"))))
    parts.append(out(subjects, F.col("thing"), F.lit(f"<{base}fileId>"), file))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.distinct()


def key_notes(lines: DataFrame, base: str, k: Lookups) -> DataFrame:
    """(kit, class, prop, note, names): a row for each key worth a note. ``deprecated``: what replaces it; ``elsewhere``:
    the classes of its kit that have it; ``unknown``: up to three declared keys of the class that hold its name or are held
    in it. Keys of a kit that is installed and declares nothing are left alone, and references are never noted."""
    k = k.measured()
    keys = _declared(_lines(lines, base, k), k).where("NOT is_object").select("kit", "class", "prop", "known").distinct()
    retired = k.deprecated.dropDuplicates(["kit", "prop"]).select("kit", "prop", "replacement", F.lit(True).alias("retired"))
    keys = keys.join(retired, ["kit", "prop"], "left")
    gone = keys.where("retired").select("kit", "class", "prop", F.lit("deprecated").alias("note"), F.array_compact(F.array("replacement")).alias("names"))
    open_ = keys.where("retired IS NULL AND NOT known").select("kit", "class", "prop")
    owners = k.declared.groupBy("kit", "prop").agg(F.array_sort(F.collect_set("class")).alias("names"))
    elsewhere = open_.join(owners, ["kit", "prop"]).select("kit", "class", "prop", F.lit("elsewhere").alias("note"), "names")
    silent = k.kits.select("kit").join(k.declared.select("kit"), "kit", "left_anti")
    unknown = open_.join(owners, ["kit", "prop"], "left_anti").join(silent, "kit", "left_anti")
    names = k.declared.join(k.deprecated, ["kit", "prop"], "left_anti").select("kit", "class", F.col("prop").alias("name")).distinct()
    a, b = F.lower("prop"), F.lower("name")
    near = (a != b) & (((F.length(a) >= 4) & b.contains(a)) | ((F.length(b) >= 4) & a.contains(b)))
    hints = unknown.join(names, ["kit", "class"], "left").groupBy("kit", "class", "prop").agg(F.slice(F.array_sort(F.collect_set(F.when(near, F.col("name")))), 1, 3).alias("names"))
    return gone.unionByName(elsewhere).unionByName(hints.select("kit", "class", "prop", F.lit("unknown").alias("note"), "names"))
