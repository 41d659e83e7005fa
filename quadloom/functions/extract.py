"""Facts from Markdown documents: frontmatter, links, fenced blocks."""

from __future__ import annotations

import re

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workers import ship


class DuplicateKeys(ValueError):
    pass


def split_frontmatter(text: str) -> tuple[str | None, str]:
    """(frontmatter, body); without an opening or a closing line there is none."""
    lines = text.splitlines(keepends=True)
    if not lines or lines[0].rstrip("\r\n") != "---":
        return None, text
    for i, line in enumerate(lines[1:], 1):
        if line.rstrip() == "---":
            return "".join(lines[1:i]), "".join(lines[i + 1 :])
    return None, text


class _Strict(yaml.SafeLoader):
    """Keys keep their order; a key that a mapping repeats at any depth is an error. Dates stay text."""


_Strict.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}


_TEXT = r"[A-Za-z](?:[A-Za-z0-9_./()+=@;, -]|:(?=[A-Za-z0-9/]))*(?<! )"
_ENTRY = re.compile(rf"""( *)(?:([A-Za-z_][A-Za-z0-9_.-]{{0,99}}):|-)(?: +(?:(0|-?[1-9][0-9]{{0,17}})|({_TEXT}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})|"([A-Za-z0-9_./()+=@;,:#&!?' -]*)"|'([A-Za-z0-9_./()+=@;,:#&!?" -]*)'))? *""")
_NULL, _WORDS = {"null", "Null", "NULL"}, {"yes", "no", "true", "false", "on", "off", "null"}


def simple_frontmatter(text: str) -> dict | None:
    """What YAML reads from block mappings of plain keys, and lists, of one-line values; None where it takes YAML to tell,
    repeated keys among that. It is some thirty times as fast."""
    rows = []
    for line in text.split("\n"):
        if line.strip(" "):
            if (m := _ENTRY.fullmatch(line)) is None:
                return None
            indent, key, number, plain, *quoted = m.groups()
            value = int(number) if number is not None else plain if plain is not None else next((x for x in quoted if x is not None), None)
            given = value is not None
            if plain in _NULL:
                value = plain = None
            if plain is not None and plain.lower() in _WORDS or key is not None and key.lower() in _WORDS or key is None and not given:
                return None
            rows.append((len(indent), key, given, value))
    at, end = 0, (-1, None, False, None)
    rows.append(end)

    def mapping(depth: int) -> dict | None:
        nonlocal at
        out: dict = {}
        while rows[at][0] == depth and rows[at][1] is not None:
            _, key, given, value = rows[at]
            at += 1
            if key in out:
                return None
            below, name = rows[at][:2]
            if not given and below >= depth and name is None and rows[at] is not end:
                value = []
                while rows[at][0] == below and rows[at][1] is None:
                    value.append(rows[at][3])
                    at += 1
            elif not given and below > depth and (value := mapping(below)) is None:
                return None
            out[key] = value
            if rows[at][0] > depth:
                return None
        return out

    found = mapping(rows[0][0]) if rows[0][1] is not None else None
    return found if rows[at] is end else None


def parse_frontmatter(text: str) -> dict:
    if (simple := simple_frontmatter(text)) is not None:
        return simple
    repeated: list[str] = []

    def mapping(loader, node):
        out = {}
        for k, v in node.value:
            key = loader.construct_object(k, deep=True)
            if key in out:
                repeated.append(str(key))
            out[key] = loader.construct_object(v, deep=True)
        return out

    class Loader(_Strict):
        pass

    Loader.add_constructor("tag:yaml.org,2002:map", mapping)
    found = yaml.load(text, Loader)
    if repeated:
        raise DuplicateKeys("repeated keys: " + ", ".join(sorted(set(repeated))))
    return found if isinstance(found, dict) else {}


def one_line(value: str) -> str:
    if "\n" not in value and "\r" not in value:
        return value
    return " ".join(x for x in (p.strip() for p in re.split(r"[\n\r]", value)) if x)


def _scalar(v) -> str | None:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)
    if isinstance(v, (int, str)):
        return one_line(str(v))
    return None


def flatten(found: dict, prefix: str = "") -> list[tuple[str, str]]:
    """(key, value) facts: a list gives one for each scalar, a mapping dotted keys; nulls and nested lists go."""
    out = []
    for k, v in found.items():
        key = f"{prefix}.{k}" if prefix else str(k)
        if isinstance(v, dict):
            out += flatten(v, key)
        elif isinstance(v, list):
            out += [(key, s) for x in v if (s := _scalar(x)) is not None]
        elif (s := _scalar(v)) is not None:
            out.append((key, s))
    return out


_FENCE = re.compile(r"^[ \t]*(```+|~~~+)")
_LINK = re.compile(r"(?<!!)\[(?:[^\[\]]|\[[^\]]*\])*\]\(\s*(?:<([^<>\n]*)>|([^\s()]*(?:\([^\s()]*\)[^\s()]*)*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)")
_AUTO = re.compile(r"<(https?://[^\s<>]+)>")


def without_code(text: str) -> str:
    out, fence = [], None
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if fence:
            if m and m[1].startswith(fence):
                fence = None
        elif m:
            fence = m[1]
        else:
            out.append(line)
    return re.sub(r"(`+)(?:(?!\1).)*?\1", "", "\n".join(out), flags=re.S)


def percent_decode(text: str) -> str:
    """Escapes that are not valid stay as they are; a plus sign is a plus sign."""
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode())
    return raw.decode("utf-8", "replace")


def normalize_path(target: str, folder: str = "") -> str | None:
    """A link's path from the root: a leading slash is the root; above it there is nothing; ``.md`` is added to a bare name."""
    parts: list[str] = [] if target.startswith("/") else [p for p in folder.split("/") if p]
    for p in target.split("/"):
        if p in ("", "."):
            continue
        if p == "..":
            if not parts:
                return None
            parts.pop()
        else:
            parts.append(p)
    if not parts:
        return None
    return "/".join(parts) if "." in parts[-1] else "/".join(parts) + ".md"


def link_targets(body: str, path: str) -> list[tuple[bool, str | None, str]]:
    """(external, path from the root, target as written) of each link, in the order of the text, autolinks last."""
    out: list[tuple[bool, str | None, str]] = []
    text = without_code(body)
    for m in _LINK.finditer(text):
        target = m[1] if m[1] is not None else m[2]
        if re.match(r"(?i)https?://", target):
            out.append((True, None, target))
        elif target := percent_decode(target.partition("#")[0]):
            out.append((False, normalize_path(target, path.rpartition("/")[0]), target))
    return out + [(True, None, m[1]) for m in _AUTO.finditer(text)]


def links(body: str, path: str, exists=lambda p: True) -> list[tuple[str, str]]:
    """(operator or key, target): linksTo for documents that exist, md.externalLink, else md.unresolvedLink."""
    out = []
    for external, found, target in link_targets(body, path):
        if external:
            out.append(("md.externalLink", target))
        else:
            out.append(("linksTo", found) if found and exists(found) else ("md.unresolvedLink", target))
    return out


def first_fence(body: str) -> str | None:
    """The first fenced block's text; one that is not closed runs to the end."""
    lines = body.split("\n")
    for i, line in enumerate(lines):
        if line.strip().startswith("```"):
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith("```")), len(lines))
            return "\n".join(lines[i + 1 : end])
    return None


def split_values(value: Column) -> Column:
    """A comma list's parts; in a list of web addresses only a comma before another address splits."""
    web = value.rlike(r"^\s*https?://")
    parts = F.when(web, F.split(value, r",(?=\s*https?://)")).otherwise(F.split(value, ","))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def facts(docs: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(path, subject, op, object, error) of documents (path, content), null content being empty.

    Internal links are linksTo where ``paths`` (path) has their target, else md.unresolvedLink
    with the target as written; without ``paths`` no target is missing. The paths are joined, so their number is free.
    Parsing costs far more than reading, so documents are dealt out anew, however few files they came in.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                front, body = split_frontmatter(content or "")
                try:
                    for k, v in flatten(parse_frontmatter(front)) if front else []:
                        rows.append((path, k, "hasValue", v, None, None))
                except (DuplicateKeys, yaml.YAMLError) as e:
                    rows.append((path, None, None, None, str(e).splitlines()[0], None))
                for external, found, target in link_targets(body, path):
                    if external or found is None:
                        rows.append((path, "md.externalLink" if external else "md.unresolvedLink", "hasValue", target, None, None))
                    else:
                        rows.append((path, path, "linksTo", found, None, target))
            yield pd.DataFrame(rows, columns=["path", "subject", "op", "object", "error", "written"])

    ship(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select("path", "content").repartition(parts, "path", "content").mapInPandas(run, "path string, subject string, op string, object string, error string, written string")
    if paths is None:
        return found.drop("written")
    # only links look for a path; the other rows stay with their document's, so no common value and no null is one key of all
    key = F.when(F.col("written").isNotNull(), F.concat(F.lit("+"), "object")).otherwise(F.concat(F.lit("-"), "path"))
    known = paths.select(F.concat(F.lit("+"), "path").alias("key"), F.lit(True).alias("there")).distinct()
    missing = F.col("written").isNotNull() & F.col("there").isNull()

    def either(a, b):
        return F.when(missing, a).otherwise(F.col(b)).alias(b)

    return found.withColumn("key", key).join(known, "key", "left").select(
        "path", either(F.lit("md.unresolvedLink"), "subject"), either(F.lit("hasValue"), "op"), either(F.col("written"), "object"), "error"
    )
