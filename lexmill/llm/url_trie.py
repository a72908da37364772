"""URL filters: one trie over reversed host labels and then path segments.

An entry is a host, optionally with a path: ``example.net`` holds for the host
and every host below it; ``news.example.net/archive`` holds for that very host,
for that path and every path below it.  Of the entries that hold for a URL the
longest (most labels and segments) decides, whether it allows or blocks; an
entry that is listed for both blocks.  A URL that no entry holds for is allowed.

Entries are read into a trie that every executor gets, after its size has been
checked; a list beyond ``trie_bytes`` is instead joined with the prefixes of the
URLs, which has the same result.
"""

from __future__ import annotations

import csv
import pickle
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.llm.common import need

TRIE_BYTES = 64 << 20

#: What an entry's label or segment takes in a worker: a dictionary, its place in the parent and the string.
_PART_BYTES, _ENTRY_BYTES = 480, 320

#: The list that the registered query applies: unwanted hosts, and exceptions below them.
PRODUCTION_LIST = str(Path(__file__).with_name("url_rules.csv"))


def read_rules(path: str) -> list[tuple[str, str]]:
    """(entry, action) of a list with these two columns; lines that start with # are comments."""
    with Path(path).open(encoding="utf-8", newline="") as lines:
        rows = csv.DictReader(line for line in lines if not line.startswith("#"))
        return [(r["entry"], r["action"]) for r in rows]


def _host(url: Column) -> Column:
    authority = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#\s]*)", 1)
    bare = F.regexp_extract(url, r"^\s*([^/?#\s]*)", 1)
    name = F.lower(F.when(authority != "", authority).otherwise(bare))
    name = F.regexp_replace(F.regexp_replace(name, r"^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(name, r"^\.+|\.+$", "")


def _path(url: Column) -> Column:
    rest = F.regexp_replace(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?[^/?#\s]*", "")
    return F.regexp_replace(rest, r"[?#].*$", "")


def url_keys(url: Column) -> tuple[Column, Column]:
    """(reversed labels of the host, segments of the path); both empty for a null URL.

    Scheme, user, port, query and fragment don't count, nor do case in the host,
    outer dots of the host and empty segments.
    """
    some = F.coalesce(url, F.lit(""))
    labels = F.filter(F.reverse(F.split(_host(some), r"\.")), lambda x: x != "")
    segments = F.filter(F.split(_path(some), "/"), lambda x: x != "")
    return labels, segments


def entry_keys(entries: DataFrame) -> DataFrame:
    """(key, action, entry) of rules (entry, action), one a key; ``block`` wins."""
    labels, segments = url_keys(F.col("entry"))
    known = entries.where("entry is not null and action in ('allow', 'block')").select("entry", "action", labels.alias("l"), segments.alias("s"))
    keyed = known.where("size(l) > 0").withColumn("key", _key("l", "s"))
    return keyed.groupBy("key").agg(F.max("action").alias("action"), F.min("entry").alias("entry"))


def _key(labels: str, segments: str) -> Column:
    """Labels and segments in one array; an empty string parts them, if there is a path."""
    return F.when(F.size(segments) > 0, F.concat(F.col(labels), F.array(F.lit("")), F.col(segments))).otherwise(F.col(labels))


class Trie:
    """Nested dictionaries; a node's decision stands at the key None."""

    def __init__(self, entries: Iterable[tuple[list[str], str, str]]) -> None:
        self.root: dict = {}
        for key, action, entry in entries:
            node = self.root
            for part in key:
                node = node.setdefault(part, {})
            node[None] = (action, entry, sum(1 for part in key if part != ""))

    def longest(self, labels: list[str], segments: list[str]) -> tuple[str, str, int] | None:
        node, found = self.root, None
        for part in labels:
            node = node.get(part)
            if node is None:
                return found
            found = node.get(None, found)
        node = node.get("")
        for part in segments:
            if node is None:
                break
            node = node.get(part)
            if node is not None:
                found = node.get(None, found)
        return found


@lru_cache(maxsize=1)
def _trie(entries: bytes) -> Trie:
    """Built once a worker, whatever number of tasks it runs."""
    return Trie(pickle.loads(entries))  # noqa: S301


def _match(entries):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(entries.value)
        for batch in batches:
            found = [trie.longest(a, b) or ("allow", None, 0) for a, b in zip(batch.column("l").to_pylist(), batch.column("s").to_pylist(), strict=True)]
            action, entry, depth = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(action, pa.string()), pa.array(entry, pa.string()), pa.array(depth, pa.int32())],
                names=["page_id", "url", "action", "entry", "depth"],
            )

    return run


def filter_urls(spark: SparkSession, pages: DataFrame, rules: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(page_id, url, action, entry, depth) of every row of ``pages``.

    ``entry`` is the entry that decided and ``depth`` its labels and segments;
    null and 0 where none holds, as for null and empty URLs, which are allowed.
    ``rules`` has entry and action; null entries, entries without a host and
    actions other than allow and block are ignored.
    """
    need(pages, "page_id", "url")
    need(rules, "entry", "action")
    keyed = entry_keys(rules.select("entry", "action"))
    # the list is measured where it lies; only a list within the bound comes to the driver
    parts = F.size("key") * F.lit(_PART_BYTES) + F.length(F.concat_ws("", "key")) + F.length("entry")
    size = keyed.agg(F.sum(parts + F.lit(_ENTRY_BYTES))).first()[0] or 0
    labels, segments = url_keys(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), labels.alias("l"), segments.alias("s"))
    if size > trie_bytes:
        return match_by_join(rows, keyed)
    entries = [(r["key"], r["action"], r["entry"]) for r in keyed.collect()]
    schema = T.StructType(
        [
            T.StructField("page_id", pages.schema["page_id"].dataType),
            T.StructField("url", T.StringType()),
            T.StructField("action", T.StringType()),
            T.StructField("entry", T.StringType()),
            T.StructField("depth", T.IntegerType()),
        ]
    )
    sent = spark.sparkContext.broadcast(pickle.dumps(sorted(entries, key=lambda e: e[0])))
    return rows.mapInArrow(_match(sent), schema)


def match_by_join(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """The same by joining all prefixes of the URLs with the entries, for lists of any size."""
    numbered = rows.withColumn("u", F.concat(F.col("l"), F.array(F.lit("")), F.col("s")))
    distinct = numbered.select("u", "l", "s").distinct()
    hosts = F.transform(F.filter(F.sequence(F.lit(0), F.size("l")), lambda n: n > 0), lambda n: F.slice("l", F.lit(1), n))
    paths = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("s")), lambda n: n > 0),
        lambda n: F.concat(F.col("l"), F.array(F.lit("")), F.slice("s", F.lit(1), n)),
    )
    prefixes = distinct.select("u", F.explode(F.concat(hosts, paths)).alias("key"))
    depth = F.size(F.filter("key", lambda x: x != ""))
    best = Window.partitionBy("u").orderBy(F.desc(F.size("key")))
    found = prefixes.join(keyed, "key").withColumn("depth", depth).withColumn("k", F.row_number().over(best)).where("k = 1")
    out = numbered.join(found.select("u", "action", "entry", "depth"), "u", "left")
    return out.select("page_id", "url", F.coalesce("action", F.lit("allow")).alias("action"), "entry", F.coalesce("depth", F.lit(0)).alias("depth"))
