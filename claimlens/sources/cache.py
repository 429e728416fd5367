"""Reference documents in files: Markdown with front matter, and the older header form.

The store of record is Parquet of REFERENCE; these files are read and written for exchange.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions.ids import cache_name
from claimlens.functions.text import yaml_scalar

FILE = "struct<filename:string,download_url:string,content_type:string,size_bytes:bigint,checksum:string,description:string,local_path:string>"
REFERENCE = (
    "reference_id string, title string, content string, content_type string, authors array<string>, journal string, year string, doi string, "
    f"keywords array<string>, publication_types array<string>, supplementary_files array<{FILE}>, metadata map<string,string>, full_text_provider string, "
    "full_text_url string, oa_status string, license string, local_pdf_path string, is_preprint boolean, peer_review_status string, full_text_attempted boolean"
)
_PLAIN = ("title", "journal", "year", "doi", "full_text_provider", "full_text_url", "oa_status", "license", "local_pdf_path", "peer_review_status")
_LISTS = ("authors", "keywords", "publication_types")
_FRONT = re.compile(r"\A---[ \t]*\r?\n(.*?)^---[ \t]*\r?$\n?(.*)\Z", re.S | re.M)
_CONTENT = re.compile(r"^## Content[ \t]*\r?$\n?", re.M)


def _listed(value) -> list[str] | None:
    if not value:
        return None
    return [str(v) for v in value] if isinstance(value, list) else [str(value)]


def _files(value) -> list[dict] | None:
    names = [f[0] for f in (x.split(":", 1) for x in FILE[7:-1].split(","))]
    rows = [{n: f.get(n) for n in names} for f in value or () if isinstance(f, dict) and f.get("filename")]
    return rows or None


def parse_markdown(text: str) -> dict | None:
    """A record from front matter and body; None if there is no front matter."""
    m = _FRONT.match(text)
    if not m:
        return None
    try:
        head = yaml.safe_load(m[1]) or {}
    except yaml.YAMLError:
        return None
    if not isinstance(head, dict) or not head.get("reference_id"):
        return None
    parts = _CONTENT.split(m[2], maxsplit=1)
    content = (parts[1] if len(parts) > 1 else m[2]).lstrip("\r\n").rstrip()
    record = {k: None if head.get(k) is None else str(head[k]) for k in _PLAIN}
    record |= {k: _listed(head.get(k)) for k in _LISTS}
    extra = head.get("metadata") if isinstance(head.get("metadata"), dict) else {}
    return record | {
        "reference_id": str(head["reference_id"]),
        "content": content or None,
        "content_type": str(head.get("content_type") or "unknown"),
        "supplementary_files": _files(head.get("supplementary_files")),
        "metadata": {str(k): str(v) for k, v in extra.items()},
        "is_preprint": head.get("is_preprint"),
        "full_text_attempted": bool(head.get("full_text_attempted", False)),
    }


def parse_legacy(text: str) -> dict | None:
    """A record from `Key: value` lines up to a blank one; the rest is content."""
    head, _, body = text.replace("\r\n", "\n").partition("\n\n")
    values = dict(line.split(": ", 1) for line in head.split("\n") if ": " in line)
    if "ID" not in values:
        return None
    record = dict.fromkeys((*_PLAIN, *_LISTS, "supplementary_files", "is_preprint"))
    record |= {k.lower(): values[k] for k in ("Title", "Journal", "Year", "DOI") if k in values}
    return record | {"reference_id": values["ID"], "authors": values["Authors"].split(", ") if values.get("Authors") else None, "content": body.strip() or None, "content_type": values.get("ContentType", "unknown"), "metadata": {}, "full_text_attempted": False}


def parse_cached(text: str) -> dict | None:
    return parse_markdown(text) if text.startswith("---") else parse_legacy(text)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """References of a folder of .md and .txt files; of two of one name, the .md counts."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.{md,txt}").select(F.col("_metadata.file_name").alias("name"), "value")
    stem = F.regexp_replace("name", r"\.(md|txt)$", "")
    first = raw.withColumn("rank", F.row_number().over(Window.partitionBy(stem).orderBy(F.col("name").endswith(".md").desc()))).where("rank = 1").select("value")
    return parse_references(first)


def read_named(reference_ids: DataFrame, folder: str) -> DataFrame:
    """References of a cache folder that all executors share, for the ids (reference_id, normal
    form) of a table: tasks open the files of these ids and no others, of any other number in
    the folder. An id's .md file counts before its .txt file; ids without either have no row."""
    import os
    from urllib.parse import unquote, urlparse

    where = unquote(urlparse(folder).path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for stem in batch["stem"]:
                for suffix in (".md", ".txt"):
                    try:
                        with open(os.path.join(where, stem + suffix), encoding="utf-8") as f:
                            found.append(f.read())
                        break
                    except FileNotFoundError:
                        continue
            yield pd.DataFrame({"value": found}, dtype=object)

    stems = reference_ids.select(cache_name(F.col("reference_id"), "").alias("stem")).where("stem <> ''").distinct()
    return parse_references(stems.mapInPandas(run, "value string"))


def parse_references(values: DataFrame) -> DataFrame:
    """REFERENCE rows from a column `value` of file contents; what can't be read is left out."""
    names = T._parse_datatype_string(REFERENCE).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [r for v in batch["value"] if v and (r := parse_cached(v))]
            yield pd.DataFrame([[r.get(n) for n in names] for r in found], columns=names, dtype=object)

    return values.select("value").mapInPandas(run, REFERENCE)


def render_markdown(r: dict) -> str:
    lines = ["---", f"reference_id: {yaml_scalar(r['reference_id'])}"]
    for key in (*_PLAIN, "content_type"):
        if r.get(key):
            lines.append(f'year: "{r[key]}"' if key == "year" else f"{key}: {yaml_scalar(r[key])}")
    for key in _LISTS:
        if r.get(key):
            lines += [f"{key}:", *(f"- {yaml_scalar(v)}" for v in r[key])]
    if r.get("is_preprint") is not None:
        lines.append(f"is_preprint: {str(r['is_preprint']).lower()}")
    if r.get("full_text_attempted"):
        lines.append("full_text_attempted: true")
    if r.get("metadata"):
        lines += ["metadata:", *(f"  {yaml_scalar(k)}: {yaml_scalar(v)}" for k, v in sorted(r["metadata"].items()))]
    if r.get("supplementary_files"):
        lines.append("supplementary_files:")
        for f in r["supplementary_files"]:
            given = [(k, v) for k, v in f.items() if v is not None]
            lines += [f"{'- ' if n == 0 else '  '}{k}: {v if isinstance(v, int) else yaml_scalar(v)}" for n, (k, v) in enumerate(given)]
    lines += ["---", ""]
    if r.get("title"):
        lines += [f"# {r['title']}"]
    for label, value in (("Authors", ", ".join(r.get("authors") or [])), ("Journal", r.get("journal")), ("DOI", r.get("doi"))):
        if value:
            lines.append(f"**{label}:** {value}")
    return "\n".join([*lines, "", "## Content", "", r.get("content") or "", ""])


def to_markdown(refs: DataFrame) -> DataFrame:
    """(file, value) for each reference: its cache file's name and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch["record"].map(lambda r: render_markdown(_plain(r)))
            yield pd.DataFrame({"file": batch["file"], "value": rows})

    record = F.struct(*refs.columns).alias("record")
    return refs.select(cache_name(F.col("reference_id")).alias("file"), F.to_json(record).alias("record")).mapInPandas(run, "file string, value string")


def _plain(text: str) -> dict:
    import json

    return json.loads(text)


def write_files_whole(rows: Iterator, folder: str) -> None:
    """Write rows (file, value) into a folder. A file appears under its name once whole; a task
    that breaks off leaves what was there, and one that runs again writes the same."""
    import os
    import uuid

    for r in rows:
        part = os.path.join(folder, f".{r['file']}.{uuid.uuid4().hex}")
        try:
            with open(part, "w", encoding="utf-8") as f:
                f.write(r["value"])
            os.replace(part, os.path.join(folder, r["file"]))
        finally:
            if os.path.exists(part):
                os.remove(part)


def write_folder(files: DataFrame, folder: str) -> None:
    """Files (file, value) in a folder that all executors share, each whole or not at all."""
    import os
    from urllib.parse import unquote, urlparse

    where = unquote(urlparse(folder).path)
    os.makedirs(where, exist_ok=True)
    files.select("file", "value").foreachPartition(lambda rows: write_files_whole(rows, where))


def write_markdown(refs: DataFrame, path: str) -> None:
    """One cache file per reference in a folder that all executors share."""
    write_folder(to_markdown(refs), path)


def upsert(store: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """The store with new references in place of those of the same id. Of new records of one id
    the one counts that is last by the column `order`, else by its text as JSON."""
    whole = F.struct(*new.columns)
    last = F.max_by(whole, F.struct(F.col(order), F.to_json(whole)) if order else F.to_json(whole))
    once = new.groupBy(F.col("reference_id").alias("_id")).agg(last.alias("r")).select("r.*")
    return store.join(once.select("reference_id"), "reference_id", "left_anti").unionByName(once)


def lookup(refs: DataFrame, reference_ids: list[str], form: str = "json") -> DataFrame:
    """(reference_id, value) for the ids, as json, yaml, md or text."""
    found = refs.where(F.col("reference_id").isin(*reference_ids))
    if form == "json":
        return found.select("reference_id", F.to_json(F.struct(*refs.columns)).alias("value"))
    if form == "md":
        return to_markdown(found).join(found.select("reference_id", cache_name(F.col("reference_id")).alias("file")), "file").select("reference_id", "value")
    if form == "text":
        shown = F.slice("authors", 1, 3)
        names = F.concat(F.array_join(shown, ", "), F.when(F.size("authors") > 3, " et al.").otherwise(""))
        return found.select("reference_id", F.concat_ws("\n", "title", names, F.concat_ws(" ", "journal", "year"), F.lit(""), "content").alias("value"))
    if form == "yaml":

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"reference_id": batch["reference_id"], "value": batch["value"].map(lambda v: yaml.safe_dump(_plain(v), allow_unicode=True, sort_keys=False))})

        return found.select("reference_id", F.to_json(F.struct(*refs.columns)).alias("value")).mapInPandas(run, "reference_id string, value string")
    raise ValueError(f"unknown form: {form}")
