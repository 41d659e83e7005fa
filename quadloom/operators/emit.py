"""From lines ``subject | operator | object`` to quads; the lookups are small vocabulary tables, joined by broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import split_values


def percent_encode(c: Column) -> Column:
    """Escapes percent, quotes, backslash, space, brackets, pipe, caret, backtick and all beyond ASCII; keeps the slash."""
    out = F.url_encode(c)
    # url_encode escapes more than this rule does; the rest is put back
    for a, b in (("+", "%20"), *((f"%{ord(x):02X}", x) for x in "/:?#@!$&'()*+,;=~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def parse_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    f = F.split(column, r" \| ", 3)
    rows = lines.where(~F.col(column).rlike(r"^\s*(#|$)"))
    return rows.select(*lines.columns, F.get(f, F.lit(0)).alias("subject"), F.get(f, F.lit(1)).alias("op"), F.get(f, F.lit(2)).alias("object"))


def resolve_value(value: Column, base: str) -> Column:
    """struct(kind, value, error) of a frontmatter value: ``<a/b>`` is below the base, ``<http..>`` and web addresses are
    IRIs, a path or a ``.md`` name is a document; wiki links, mentions and bare names are refused; blank is a literal."""
    v = F.trim(value)
    inner = F.regexp_replace(v, "^<|>$", "")
    web = r"^https?://"

    def made(kind, text, error=None):
        return F.struct(F.lit(kind).alias("kind"), (text if text is not None else F.lit(None).cast("string")).alias("value"), F.lit(error).cast("string").alias("error"))

    bracket = v.rlike("^<.*>$")
    return (
        F.when(v == "", made("literal", v))
        .when(v.rlike(r"^\[\["), made("error", None, "wiki link"))
        .when(v.startswith("@"), made("error", None, "mention"))
        .when(bracket & (inner == ""), made("error", None, "empty reference"))
        .when(bracket & inner.rlike(web), made("iri", inner))
        .when(bracket & inner.contains("/"), made("iri", F.concat(F.lit(base), percent_encode(inner))))
        .when(bracket, made("error", None, "bare reference"))
        .when(v.rlike(web), made("iri", v))
        .when(v.contains("/") | v.endswith(".md"), made("iri", F.concat(F.lit(base + "File/"), percent_encode(F.regexp_replace(v, "^/", "")))))
        .otherwise(made("error", None, "bare name"))
    )


def thing_iri(base: str, cls: Column, identifier: Column) -> Column:
    return F.concat(F.lit(f"<{base}"), cls, F.lit("/"), percent_encode(identifier), F.lit(">"))


def anchors(lines: DataFrame, base: str) -> DataFrame:
    """(path, class, subject) of each document: the class of its first key ``kit.Class.prop`` and the thing its id names, else its file."""
    keyed = lines.where(F.size(F.split("subject", r"\.")) == 3)
    cls = F.split("subject", r"\.").getItem(1)
    prop = F.split("subject", r"\.").getItem(2)
    own = F.concat(F.lower(F.substring(cls, 1, 1)), F.expr("substring(split(subject, '[.]')[1], 2)"), F.lit("Id"))
    ident = F.when((prop == "id") | (prop == own), F.col("object"))
    per = keyed.groupBy("path").agg(F.min_by(cls, "subject").alias("class"), F.min(ident).alias("id"))
    file = F.concat(F.lit(f"<{base}File/"), percent_encode(F.col("path")), F.lit(">"))
    return per.select("path", "class", F.when(F.col("id").isNotNull(), thing_iri(base, F.col("class"), F.col("id"))).otherwise(file).alias("subject"))


def emit(lines: DataFrame, base: str, properties: DataFrame) -> DataFrame:
    """(path, s, p, o) of lines (path, subject, op, object); ``properties`` has (key, iri, datatype, is_object)."""
    file = F.concat(F.lit(f"<{base}File/"), percent_encode(F.col("path")), F.lit(">"))
    a = anchors(lines, base).withColumnRenamed("subject", "thing")
    rows = lines.join(a, "path", "left").where(F.coalesce(F.col("object"), F.lit("")) != "")
    linked = rows.where("op = 'linksTo'").select("path", file.alias("s"), F.lit(f"<{base}md/linksTo>").alias("p"), F.concat(F.lit(f"<{base}File/"), percent_encode(F.regexp_replace("object", "^/", "")), F.lit(">")).alias("o"))
    keyed = rows.where("op = 'hasValue'").join(F.broadcast(properties.withColumnRenamed("key", "subject")), "subject", "left")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.col("object"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    typed = F.when(F.col("datatype").isNull() | F.col("datatype").endswith("#string"), quoted).otherwise(F.concat(quoted, F.lit("^^<"), F.col("datatype"), F.lit(">")))
    refs = keyed.where("is_object").withColumn("part", F.explode(split_values(F.col("object")))).withColumn("r", resolve_value(F.col("part"), base)).where("r.kind = 'iri'")
    refs = refs.select("path", F.coalesce("thing", file).alias("s"), F.concat(F.lit("<"), F.col("iri"), F.lit(">")).alias("p"), F.concat(F.lit("<"), F.col("r.value"), F.lit(">")).alias("o"))
    plain = keyed.where("NOT coalesce(is_object, false)")
    pred = F.when(F.col("iri").isNotNull(), F.concat(F.lit("<"), F.col("iri"), F.lit(">"))).otherwise(F.concat(F.lit(f"<{base}fm/"), percent_encode(F.col("subject")), F.lit(">")))
    values = plain.select("path", F.when(F.col("iri").isNotNull(), F.coalesce("thing", file)).otherwise(file).alias("s"), pred.alias("p"), typed.alias("o"))
    bridge = a.where(~F.col("thing").startswith(f"<{base}File/")).select("path", F.col("thing").alias("s"), F.lit(f"<{base}fileId>").alias("p"), file.alias("o"))
    kind = a.select("path", F.col("thing").alias("s"), F.lit("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>").alias("p"), F.concat(F.lit(f"<{base}"), F.col("class"), F.lit(">")).alias("o"))
    out = linked
    for part in (refs, values, bridge, kind):
        out = out.unionByName(part)
    return out.distinct()


def suggest(keys: DataFrame, known: DataFrame) -> DataFrame:
    """(key, suggestions): for unknown keys up to three known ones that contain them or are contained; names of four letters and more."""
    missing = keys.select("key").distinct().join(known.select("key"), "key", "left_anti")
    near = missing.join(F.broadcast(known.select(F.col("key").alias("name"))), F.lower("key").contains(F.lower("name")) | F.lower("name").contains(F.lower("key")), "left")
    fit = F.when((F.length("key") >= 4) & (F.length("name") >= 4), F.col("name"))
    return near.groupBy("key").agg(F.slice(F.array_sort(F.collect_set(fit)), 1, 3).alias("suggestions"))
