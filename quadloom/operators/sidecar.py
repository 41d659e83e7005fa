"""From documents to history: sidecar lines at commits, their facts, and the events between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .emit import emit, percent_encode
from .history import diff_events, event_id
from .verify import malformed_lines

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def sidecar_at(tree: DataFrame, blobs: DataFrame) -> DataFrame:
    """(commit, path, pos, line) of ``tree`` (commit, path, blob) and ``blobs`` (blob, content).

    A path that a commit does not have is an empty sidecar and gives no rows. A blob
    that cannot be read is an error and never an empty sidecar: it gives one row with
    a null line. Blank lines and those that begin with ``#`` are left out.
    """
    held = tree.join(blobs, "blob", "left")
    lines = held.select("commit", "path", F.posexplode_outer(F.split("content", "\r?\n")).alias("pos", "line"))
    return lines.where(F.col("line").isNull() | ~F.col("line").rlike(r"^\s*(#.*)?$"))


def resolve(lines: DataFrame, base: str, properties: DataFrame) -> DataFrame:
    """(path, s, p, o): the set of facts of sidecar lines (path, line), with their subjects' anchors.

    Lines that are malformed or could not be read stop the job; those without an
    object are skipped (``dropped`` counts them); a path without lines has no anchor.
    """
    wrong = lines.where(F.col("line").isNull()).select("path", F.lit("unreadable").alias("problem")).union(malformed_lines(lines.where(F.col("line").isNotNull())).select("path", "problem"))
    if (first := wrong.limit(1).collect()):
        raise ValueError(f"{first[0].path}: {first[0].problem}")
    f = F.split("line", r" \| ", 3)
    rows = lines.select("path", f[0].alias("subject"), f[1].alias("op"), f[2].alias("object"))
    return emit(rows.where(F.trim("object") != ""), base, properties).distinct()


def dropped(lines: DataFrame) -> DataFrame:
    """One row of counts: lines read, of those malformed, without an object, and of suffixes that no operator knows."""
    f = F.split("line", r" \| ", 3)
    op, obj = F.get(f, F.lit(1)), F.get(f, F.lit(2))
    known = op.isin("hasValue", "linksTo")
    return lines.agg(
        F.count("*").alias("lines"),
        F.count_if(F.size(f) < 3).alias("malformed"),
        F.count_if((F.size(f) >= 3) & (F.trim(obj) == "")).alias("empty"),
        F.count_if((F.size(f) >= 3) & ~known).alias("unknown"),
    )


def sidecar_writes(lines: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, action, content): what bringing stored sidecars (path, content) up to ``lines`` (path, line) takes.

    Content is the sorted distinct lines. Equal content is left alone, so nothing is
    written for a document that did not change; a path without lines loses its sidecar.
    """
    new = lines.where(F.trim("line") != "").groupBy("path").agg(F.concat(F.array_join(F.array_sort(F.collect_set("line")), "\n"), F.lit("\n")).alias("new"))
    both = new.join(stored, "path", "full")
    action = F.when(F.col("new").isNull(), "remove").when(F.col("content").isNull() | (F.col("new") != F.col("content")), "write")
    return both.select("path", action.alias("action"), F.col("new").alias("content")).where("action IS NOT NULL")


def version_events(versions: DataFrame, keys: list[str]) -> DataFrame:
    """(ordinal, keys, op) between consecutive versions (ordinal, path, keys): a statement that another document still makes is not retracted, one that only moved is no event.

    ``versions`` has every commit's whole set of statements; the first is compared with nothing.
    """
    held = versions.select("ordinal", *keys).distinct()
    # the dense number of a commit, so that "the one before" is a plain equality
    order = versions.select("ordinal").distinct().withColumn("n", F.row_number().over(Window.orderBy("ordinal")))
    held = held.join(F.broadcast(order), "ordinal")
    after = held.select((F.col("n") + 1).alias("n"), *keys)
    last = order.agg(F.max("n")).first()[0] or 0
    events = diff_events(after.where(F.col("n") <= last), held.select("n", *keys), ["n", *keys])
    return events.join(F.broadcast(order), "n").select("ordinal", *keys, "op")


def event_quads(events: DataFrame, base: str, graph: str) -> DataFrame:
    """(s, p, o, g): the three quads of each event (commit, s, p, o, op): what it is about, its commit, its kind."""
    ident = event_id(F.col("op"), F.col("commit"), F.col("s"), F.col("p"), F.col("o"))
    node = F.concat(F.lit(f"<{base}event/"), ident, F.lit(">"))
    told = F.concat(F.lit("<<( "), F.concat_ws(" ", "s", "p", "o"), F.lit(" )>>"))
    commit = F.concat(F.lit(f"<{base}commit/"), F.col("commit"), F.lit(">"))
    way = F.when(F.col("op") == "+", f"<{base}assertedIn>").otherwise(f"<{base}retractedIn>")
    three = F.array(
        F.struct(F.lit(f"<{RDF}reifies>").alias("p"), told.alias("o")),
        F.struct(way.alias("p"), commit.alias("o")),
        F.struct(F.lit(f"<{RDF}type>").alias("p"), F.when(F.col("op") == "+", f"<{base}Assertion>").otherwise(f"<{base}Retraction>").alias("o")),
    )
    return events.select(node.alias("s"), F.explode(three).alias("x")).select("s", "x.p", "x.o", F.lit(f"<{graph}>").alias("g")).distinct()


def horizon(commits: DataFrame, date: str) -> DataFrame:
    """Commits from the first one at or after ``date`` 00:00:00 on; that one is compared with the empty tree (``base`` is null)."""
    first = commits.where(F.col("committer_time").cast("timestamp") >= F.lit(f"{date} 00:00:00").cast("timestamp")).agg(F.min("ordinal").alias("first"))
    kept = commits.join(F.broadcast(first), F.col("ordinal") >= F.col("first"))
    return kept.withColumn("base", F.when(F.col("ordinal") > F.col("first"), F.try_element_at("parents", F.lit(1)))).drop("first")


def now_facts(tree: DataFrame, base: str) -> DataFrame:
    """(s, p, o): path and content hash of each file; facts of the current state that history never has. An unknown hash is left out."""
    file = F.concat(F.lit(f"<{base}File/"), percent_encode(F.col("path")), F.lit(">"))
    text = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    pair = F.array(F.struct(F.lit(f"<{base}git/path>").alias("p"), text(F.col("path")).alias("o")), F.struct(F.lit(f"<{base}git/blobHash>").alias("p"), text(F.col("blob")).alias("o")))
    return tree.select(file.alias("s"), F.explode(pair).alias("x")).select("s", "x.p", "x.o").where("o IS NOT NULL")


def bare_kit_hints(values: DataFrame, kits: DataFrame, paths: DataFrame) -> DataFrame:
    """(value, suggestion): bare references whose first segment names a kit (kit) and no tracked path (path): meant is the bracket form."""
    first = F.split("value", "/").getItem(0)
    rows = values.where(F.col("value").contains("/") & ~F.col("value").rlike("^[<@\\[]|^https?://")).withColumn("kit", first)
    known = rows.join(kits.select("kit").distinct(), "kit", "left_semi")
    tops = paths.select(F.split("path", "/").getItem(0).alias("kit")).distinct()
    return known.join(tops, "kit", "left_anti").select("value", F.concat(F.lit("<"), F.col("value"), F.lit(">")).alias("suggestion"))


def rename_dates(lines: DataFrame, declared: list[str]) -> DataFrame:
    """Old date keys become the new ones where only the new one is declared."""
    key = F.regexp_extract("subject", r"([^.]*)$", 1)
    renamed = F.col("subject")
    # fixed values: old and new names
    for old, new in (("dateCreated", "createdDate"), ("dateUpdated", "updatedDate")):
        if new in declared and old not in declared:
            renamed = F.when(key == old, F.concat(F.regexp_replace("subject", r"[^.]*$", ""), F.lit(new))).otherwise(renamed)
    return lines.withColumn("subject", renamed)


def stamp_dates(docs: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """(path, content, created, updated): a new file gets both dates, a changed one ``updated``; what differs in white space alone is no change.

    ``stored`` has (path, old, created, updated).
    """
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    both = docs.join(stored, "path", "left")
    new = F.col("old").isNull()
    changed = new | (plain("content") != plain("old"))
    return both.select("path", "content", F.when(new, now).otherwise(F.col("created")).alias("created"), F.when(changed, now).otherwise(F.col("updated")).alias("updated"))


def heal_links(docs: DataFrame, renames: DataFrame) -> DataFrame:
    """(path, content): Markdown links to renamed files (old, new) point at the new path, encoded, with their fragment.

    Each document's links are cut out, joined with the renames and put back; documents
    without such a link are left as they are.
    """
    link = r"\]\((/?[^)\s#]*)((?:#[^)\s]*)?)\)"
    pieces = docs.select("path", F.split("content", link, -1).alias("gaps"), F.regexp_extract_all("content", F.lit(link), F.lit(1)).alias("to"), F.regexp_extract_all("content", F.lit(link), F.lit(2)).alias("frag"))
    found = pieces.select("path", F.posexplode(F.arrays_zip("to", "frag")).alias("pos", "x")).select("path", "pos", F.col("x.to").alias("to"), F.col("x.frag").alias("frag"))
    wanted = found.withColumn("old", F.url_decode(F.replace(F.regexp_replace("to", "^/", ""), F.lit("+"), F.lit("%2B"))))
    healed = wanted.join(renames, "old", "left").withColumn("link", F.concat(F.lit("]("), F.coalesce(F.concat(F.lit("/"), percent_encode(F.col("new"))), F.col("to")), F.col("frag"), F.lit(")")))
    # only documents that a rename touches are put together again
    back = healed.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "link"))).alias("links"), F.count("new").alias("n")).where("n > 0")
    joined = docs.join(pieces.select("path", "gaps"), "path").join(back, "path", "left")
    whole = F.array_join(F.zip_with("gaps", F.col("links.link"), lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")
    return joined.select("path", F.coalesce(whole, F.col("content")).alias("content"))


def typed_triples(facts: DataFrame, properties: DataFrame) -> DataFrame:
    """(doc, prop, value, error) of flattened frontmatter (doc, key, value, nested) and ``properties`` (key, iri, datatype).

    Empty text is no value; a nested list or mapping where a scalar belongs, an unknown key, and text that its datatype cannot read are errors.
    """
    rows = facts.where(F.trim(F.coalesce("value", F.lit(""))) != "").join(F.broadcast(properties), "key", "left")
    v = F.trim("value")
    ok = (
        F.when(F.col("datatype") == "integer", v.try_cast("bigint").isNotNull())
        .when(F.col("datatype").isin("decimal", "double"), v.try_cast("double").isNotNull())
        .when(F.col("datatype") == "boolean", v.isin("true", "false"))
        .when(F.col("datatype") == "date", v.try_cast("date").isNotNull())
        .otherwise(F.lit(True))
    )
    error = F.when(F.col("nested"), "nested").when(F.col("iri").isNull(), "unknown key").when(~ok, "datatype")
    return rows.select("doc", F.coalesce("iri", "key").alias("prop"), v.alias("value"), error.alias("error"))
