"""The term table in chunks: runs of segments whose forms are codes into the chunk's own list of forms.

One pass over the segments makes it, in Arrow batches and without a shuffle.  What
needs all occurrences of a form joins the lists of the chunks, a small part of the
cells; what is worked out by form goes back to the chunks as codes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.config import Preparation
from lexmill.operators.lexicon import lexed, merge_all

#: Tokens after which a chunk is closed, at the end of a document.
CHUNK_TOKENS = 2_000_000
_CODEC = "zstd"


@dataclass(frozen=True)
class Rules:
    """Lemma and activity of the words that a dictionary or list names, and what holds for all others."""

    tokens: pa.Array
    lemmas: pa.Array
    active: np.ndarray
    anonymous_prefix: str | None
    least: int
    unknown_active: bool

    def apply(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(lemma, active) of distinct words, as :func:`lexmill.operators.lexicon.lexed` has them."""
        active = (pc.utf8_length(words).to_numpy(zero_copy_only=False) >= self.least) & self.unknown_active
        if self.anonymous_prefix:
            active &= ~pc.starts_with(words, self.anonymous_prefix).to_numpy(zero_copy_only=False)
        if not len(self.tokens):
            return words, active
        at = pc.index_in(words, value_set=self.tokens)
        named = at.is_valid().to_numpy(zero_copy_only=False)
        active[named] = self.active[at.drop_null().to_numpy()]
        return pc.coalesce(self.lemmas.take(at), words), active


def rules(lexicon: DataFrame, prep: Preparation) -> Rules:
    """Rules of the dictionaries, which are a language's words and go to every task."""
    named = {*prep.synonyms, *prep.stopwords, *prep.expressions.values()}
    words = lexicon.select(F.col("form").alias("token"))
    if named:
        words = words.unionByName(lexicon.sparkSession.createDataFrame([(x,) for x in sorted(named)], "token string"))
    rows = lexed(words.distinct(), lexicon, prep).select("token", "lemma", "active").collect()
    tokens, lemmas = (pa.array([r[c] for r in rows], pa.string()) for c in ("token", "lemma"))
    return Rules(tokens, lemmas, np.array([bool(r["active"]) for r in rows], dtype=bool), prep.anonymous_prefix, prep.min_token_length, prep.unknown_active)


def _packed(values: np.ndarray) -> bytes:
    kind = np.uint8 if not len(values) or values.max() < 256 else np.uint16 if values.max() < 65536 else np.uint32
    data = values.astype(kind).tobytes()
    return bytes([np.dtype(kind).itemsize]) + len(data).to_bytes(8, "little") + pa.compress(data, codec=_CODEC, asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[data[0]]
    n = int.from_bytes(data[1:9], "little")
    return np.frombuffer(pa.decompress(data[9:], n, codec=_CODEC, asbytes=True) if n else b"", dtype=kind).astype(np.int64)


def cells_of(row: np.ndarray, code: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, n) of each different pair, in order."""
    key, n = np.unique(row * max(1, n_codes) + code, return_counts=True)
    return key // max(1, n_codes), key % max(1, n_codes), n


def lemmatised(words: pa.ListArray, known: Rules) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct lemmas, row, code) of the active words of lists, in their order."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    flat = words.flatten().dictionary_encode()
    lemma, active = known.apply(flat.dictionary.cast(pa.string()))
    distinct = lemma.dictionary_encode()
    token = flat.indices.to_numpy(zero_copy_only=False)
    kept = active[token] if len(token) else np.zeros(0, dtype=bool)
    row = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
    return distinct.dictionary, row[kept], distinct.indices.to_numpy(zero_copy_only=False).astype(np.int64)[token[kept]]


class _Open:
    """A chunk that is being filled."""

    def __init__(self) -> None:
        self.units: list[pa.Table] = []
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.n_rows = self.tokens = 0

    def add(self, batch: pa.Table, known: Rules) -> None:
        words = batch.column("words").combine_chunks()
        forms, row, code = lemmatised(words, known)
        self.parts.append((forms, row + self.n_rows, code))
        self.units.append(batch.drop_columns(["words"]))
        self.n_rows += len(batch)
        self.tokens += len(words.flatten())

    def closed(self, chunk: int, unit: pa.DataType) -> pa.RecordBatch:
        lists = [p[0].dictionary_encode() for p in self.parts]
        forms = pa.chunked_array([p[0] for p in self.parts], pa.string()).unique()
        # forms that only inactive words have aren't listed: codes count what occurs
        place = [pc.index_in(x.dictionary, value_set=forms).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
        code = np.concatenate([m[c] for m, (_, _, c) in zip(place, self.parts, strict=True)])
        row = np.concatenate([r for _, r, _ in self.parts])
        used, code = np.unique(code, return_inverse=True)
        forms = forms.take(pa.array(used))
        row, code, n = cells_of(row, code.astype(np.int64), len(forms))
        units = pa.concat_tables(self.units).combine_chunks()
        held = pa.StructArray.from_arrays([units.column(f.name).combine_chunks() for f in unit], fields=list(unit))
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if isinstance(values, np.ndarray) else values)
        columns = {
            "chunk": pa.array([chunk], pa.int64()),
            "forms": one(forms, pa.string()),
            "freq": one(np.bincount(code, weights=n, minlength=len(forms)).astype(np.int32), pa.int32()),
            "spread": one(np.bincount(code, minlength=len(forms)).astype(np.int32), pa.int32()),
            "units": one(held, None),
            "sizes": pa.array([_packed(np.bincount(row, minlength=self.n_rows))], pa.binary()),
            "codes": pa.array([_packed(code)], pa.binary()),
            "counts": pa.array([_packed(n)], pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def chunked(segs: DataFrame, lexicon: DataFrame, prep: Preparation, keep: tuple[str, ...] = ()) -> DataFrame:
    """(chunk, forms, freq, spread, units, sizes, codes, counts) of segments.

    ``forms`` are the active lemmas of the chunk with their occurrences and
    segments; ``units`` the segments (uci_id, uce_id, kept columns, n tokens) in
    their order.  ``sizes`` has the number of different forms of each segment,
    ``codes`` these forms and ``counts`` their occurrences there.  Numbers of
    chunks rise with the order of the rows.
    """
    known, most = rules(lexicon, prep), CHUNK_TOKENS
    rows = segs.select("uci_id", "uce_id", *keep, F.size("tokens").alias("n"), merge_all(F.col("tokens"), prep).alias("words"))
    unit_type = T.StructType(list(rows.drop("words").schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, unit = TaskContext.get().partitionId() << 32, _Open(), None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            unit = pa.struct([f for f in table.schema if f.name != "words"])
            start = 0
            if held.tokens >= most:
                # the rest of the document that the chunk ended in
                last, ids = held.units[-1].column("uci_id")[-1], table.column("uci_id").combine_chunks()
                same = pc.fill_null(pc.equal(ids, last), False).to_numpy(zero_copy_only=False)
                start = len(same) if same.all() else int(np.argmin(same))
                if start:
                    held.add(table.slice(0, start), known)
                if start < len(table):
                    yield held.closed(number, unit)
                    number, held = number + 1, _Open()
            if start < len(table):
                held.add(table.slice(start), known)
        if held.n_rows:
            yield held.closed(number, unit)

    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("forms", T.ArrayType(T.StringType())),
            T.StructField("freq", T.ArrayType(T.IntegerType())),
            T.StructField("spread", T.ArrayType(T.IntegerType())),
            T.StructField("units", T.ArrayType(unit_type)),
            *[T.StructField(c, T.BinaryType()) for c in ("sizes", "codes", "counts")],
        ]
    )
    return rows.mapInArrow(run, schema)


@dataclass
class Chunk:
    """One row of the table, unpacked."""

    number: int
    forms: pa.Array
    freq: np.ndarray
    units: pa.StructArray
    sizes: np.ndarray
    codes: np.ndarray
    counts: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        """The segment of each cell."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def unit(self, name: str) -> pa.Array:
        return self.units.field(name)


def read(table: pa.Table) -> Iterator[Chunk]:
    """The chunks of a table's rows."""
    for i in range(len(table)):
        value = lambda c: table.column(c)[i]  # noqa: B023, E731
        yield Chunk(
            value("chunk").as_py(), value("forms").values, value("freq").values.to_numpy(zero_copy_only=False), value("units").values,
            *[_unpacked(value(c).as_py()) for c in ("sizes", "codes", "counts")],
        )


def each(chunks: DataFrame, make: Callable[[Chunk], pa.Table | None], schema: str | T.StructType) -> DataFrame:
    """What ``make`` finds in every chunk, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for chunk in read(pa.Table.from_batches([batch.slice(i, 1)])):
                    if (found := make(chunk)) is not None:
                        yield from found.to_batches(max_chunksize=1 << 16)

    return chunks.mapInArrow(run, schema)


def each_with(chunks: DataFrame, known: DataFrame, make: Callable[[Chunk, pa.Table], pa.Table], schema: str | T.StructType) -> DataFrame:
    """The same with the rows that ``known`` (chunk, ...) has for the chunk."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables([make(chunk, right) for chunk in read(left)])

    return chunks.groupBy("chunk").cogroup(known.withColumnRenamed("chunk", "of").groupBy("of")).applyInArrow(run, schema)


def local_forms(chunks: DataFrame) -> DataFrame:
    """(chunk, code, form, freq, n_uce): the lists of the chunks."""
    listed = chunks.select("chunk", F.posexplode(F.arrays_zip("forms", "freq", "spread")).alias("code", "x"))
    return listed.select("chunk", "code", F.col("x.forms").alias("form"), F.col("x.freq").cast("long").alias("freq"), F.col("x.spread").cast("long").alias("n_uce"))


def form_stats(chunks: DataFrame) -> DataFrame:
    """(form, freq, n_uce): occurrences and segments of every active form."""
    return local_forms(chunks).groupBy("form").agg(F.sum("freq").alias("freq"), F.sum("n_uce").alias("n_uce"))


def rare_codes(chunks: DataFrame, min_occurrences: int) -> DataFrame:
    """(chunk, code) of the forms that occur less often in the whole corpus; only those rare in a chunk are counted."""
    few = local_forms(chunks).where(F.col("freq") < min_occurrences).select("chunk", "code", "form")
    stats = form_stats(chunks).where(F.col("freq") < min_occurrences).select("form")
    return few.join(stats, "form", "left_semi").select("chunk", "code")


def _kept(chunk: Chunk, rare: pa.Table) -> np.ndarray:
    """Which of the cells have a form that is not rare."""
    good = np.ones(len(chunk.forms), dtype=bool)
    good[rare.column("code").to_numpy()] = False
    return good[chunk.codes]


def pairs(chunks: DataFrame, rare: DataFrame) -> DataFrame:
    """(uce_id, form), each once, of the forms that are not rare."""

    def make(chunk: Chunk, few: pa.Table) -> pa.Table:
        kept = _kept(chunk, few)
        return pa.table({"uce_id": chunk.unit("uce_id").take(pa.array(chunk.rows[kept])), "form": chunk.forms.take(pa.array(chunk.codes[kept]))})

    return each_with(chunks, rare, make, "uce_id string, form string")


def row_sizes(chunks: DataFrame, rare: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(uce_id, kept columns, n_forms) of the segments that hold a form that is not rare."""

    def make(chunk: Chunk, few: pa.Table) -> pa.Table:
        n = np.bincount(chunk.rows[_kept(chunk, few)], minlength=len(chunk.sizes))
        some = pa.array(np.flatnonzero(n))
        return pa.table({c: chunk.unit(c).take(some) for c in ("uce_id", *keep)} | {"n_forms": n[n > 0]})

    return each_with(chunks, rare, make, "uce_id string, " + "".join(f"{c} string, " for c in keep) + "n_forms long")


def count_matrix(chunks: DataFrame, rare: DataFrame) -> DataFrame:
    """(doc_id, form, n) of the forms that are not rare; a document's rows lie in one chunk."""
    kind = chunks.schema["units"].dataType.elementType["uci_id"].dataType.simpleString()

    def make(chunk: Chunk, few: pa.Table) -> pa.Table:
        kept, ids = _kept(chunk, few), chunk.unit("uci_id").dictionary_encode()
        doc = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)[chunk.rows[kept]]
        key, place = np.unique(doc * max(1, len(chunk.forms)) + chunk.codes[kept], return_inverse=True)
        n = np.bincount(place, weights=chunk.counts[kept], minlength=len(key)).astype(np.int64)
        size = max(1, len(chunk.forms))
        return pa.table({"doc_id": ids.dictionary.take(pa.array(key // size)), "form": chunk.forms.take(pa.array(key % size)), "n": n})

    return each_with(chunks, rare, make, f"doc_id {kind}, form string, n long")


def filled(chunks: DataFrame, min_occurrences: int, keep: tuple[str, ...]) -> DataFrame:
    """(kept columns, n_filled): segments that hold a form that is not rare.

    A form that is frequent enough in its chunk is so in the corpus; the forms of
    the few segments that have none of these are looked up.
    """

    def make(chunk: Chunk) -> pa.Table:
        sure = np.zeros(len(chunk.sizes), dtype=bool)
        sure[chunk.rows[chunk.freq[chunk.codes] >= min_occurrences]] = True
        labels = pa.table({c: chunk.unit(c) for c in keep})
        known = labels.filter(pa.array(sure)).group_by(list(keep)).aggregate([([], "count_all")]).rename_columns([*keep, "n"])
        known = known.append_column("uce_id", pa.nulls(len(known), pa.string())).append_column("form", pa.nulls(len(known), pa.string()))
        open_ = ~sure[chunk.rows]
        at = pa.array(chunk.rows[open_])
        rest = labels.take(at).append_column("n", pa.array(np.zeros(len(at), dtype=np.int64)))
        rest = rest.append_column("uce_id", chunk.unit("uce_id").take(at)).append_column("form", chunk.forms.take(pa.array(chunk.codes[open_])))
        return pa.concat_tables([known, rest])

    found = each(chunks, make, "".join(f"{c} string, " for c in keep) + "n long, uce_id string, form string")
    enough = form_stats(chunks).where(F.col("freq") >= min_occurrences).select("form")
    looked = found.where("form is not null").join(enough, "form", "left_semi").select(*keep, "uce_id").distinct()
    return found.where("form is null").select(*keep, "n").unionByName(looked.select(*keep, F.lit(1).cast("long").alias("n"))).groupBy(*keep).agg(F.sum("n").alias("n_filled"))


def profile(chunks: DataFrame, min_occurrences: int, keep: tuple[str, ...]) -> DataFrame:
    """(form, kept columns, n): segments with the form by the values of the kept columns, of forms that are not rare."""

    def make(chunk: Chunk) -> pa.Table:
        labels = pa.table({c: chunk.unit(c) for c in keep})
        groups = labels.group_by(list(keep)).aggregate([])
        place = {tuple(x.values()): i for i, x in enumerate(groups.to_pylist())}
        group = np.array([place[x] for x in zip(*[labels.column(c).to_pylist() for c in keep], strict=True)], dtype=np.int64)
        key = chunk.codes * len(place) + group[chunk.rows]
        cell, place_of, n = np.unique(key, return_inverse=True, return_counts=True)
        freq = np.bincount(place_of, weights=chunk.counts, minlength=len(cell)).astype(np.int64)
        out = {"form": chunk.forms.take(pa.array(cell // len(place)))} | {c: groups.column(c).take(pa.array(cell % len(place))) for c in keep}
        return pa.table(out | {"n": n.astype(np.int64), "freq": freq})

    found = each(chunks, make, "form string, " + "".join(f"{c} string, " for c in keep) + "n long, freq long")
    # one shuffle by form serves the counts and the forms' totals
    counts = found.repartition("form").groupBy("form", *keep).agg(F.sum("n").alias("n"), F.sum("freq").alias("freq"))
    return counts.withColumn("all", F.sum("freq").over(Window.partitionBy("form"))).where(F.col("all") >= min_occurrences).select("form", *keep, "n")


