"""Language identification with interpolated Kneser-Ney character models.

Texts are lower-cased letters with single spaces between words. All learnable documents are counted: tasks count the
4-grams of their own rows, Spark adds the counts up, and every count is kept. Up to ``MAX_PAIRS`` (language, 4-gram)
counts and ``MAX_CELLS`` cells the tasks hold the model: per order a sorted array of packed n-grams and, per language,
their interpolated log probabilities; contexts likewise with their back-off weights. A larger model stays in written
tables that Spark computes from all counts, and blocks of texts are joined with the terms of their own n-grams; both
forms give the same probabilities (kept in single precision) for texts of any length: a text that is read
in several parts carries its last letters over each cut.

A text gets the language of the lowest cross-entropy per character. It is rejected if it has no letter, or if its
cross-entropy lies far above what texts of that language and length have: the limit is calibrated per language on all
learnable documents of which the language is predicted. A language with fewer than FEW of them takes the spread and the
quantile of the other languages, about its own median if it has any such document. The score is the language's share of
the likelihood, on at most 64 characters' worth of it, so that long texts do not all score 1.

Cases: a null text, or one without a letter, is ``und`` with score 0, rejected; ties go to the first language in
sorted order; a null doc_id is not held out and never learned from; if nothing can be learned (an empty table, no
language given) every text is ``und``; repeated rows each get their row; letters beyond 16 bits share 6,400 codes by
their code point, so a few of them are taken for each other; other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendwise.llm.common import held_out, learnable, materialize, text_key

ORDER = 4
MAX_PAIRS = 1 << 20
MAX_CELLS = 1 << 23  # n-grams times languages in a model that tasks hold
FEW = 8              # documents from which a language's own rejection limit is made
GRID = 1 << 12       # steps per bit, or deviation, in which calibration takes its quantiles
FAR_ABOVE = 1.5      # a rejected text's cross-entropy is at least so many times its language's; texts in two of the
# learned languages stay below that
BATCH = 1 << 25      # bytes of text that are scored together against written tables
GRAMS = 1 << 18      # or distinct 4-grams
LEVEL = 9            # of their compression: they are written once and shuffled once
CHUNK = 1 << 20      # characters handled at once in a task
CELLS = 1 << 22      # sums per 4-gram and language held at once against written tables
SPACE = 32
SCORES = ["__lang_pred", "__score", "__bits", "__chars"]


def letter_table() -> np.ndarray:
    """Per UTF-16 unit value: the lower-case letter, or a space for anything that is no letter."""
    out = np.full(65536, SPACE, np.uint64)
    for c in range(65536):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 65536 else c
    return out


def _codes(text: str, table: np.ndarray) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp) or cp.max() < 65536:
        return table[cp]
    far = cp >= 65536  # letters beyond 16 bits share the private-use range
    out = table[np.where(far, 0, cp)]
    kinds, back = np.unique(cp[far], return_inverse=True)
    out[far] = np.array([0xE000 + k % 6400 if chr(k).isalpha() else SPACE for k in kinds.tolist()], np.uint64)[back]
    return out


def chunks(texts, size: int = CHUNK):
    """Lists of (row, text part) of about ``size`` characters; a longer text comes in several parts."""
    out, n = [], 0
    for row, text in enumerate(texts):
        text = text or ""
        for at in range(0, len(text), size):
            part = text[at:at + size]
            out.append((row, part))
            n += len(part)
            if n >= size:
                yield out
                out, n = [], 0
    if out:
        yield out


class Grams:
    """Parts of texts to 4-grams. A part that continues the text that the last list of parts ended with takes its contexts
    from there, so cuts change nothing. One for each batch of texts."""

    def __init__(self, table: np.ndarray):
        self.table, self.row, self.lead, self.before = table, None, np.zeros(ORDER - 1, np.uint64), SPACE

    def __call__(self, parts) -> tuple[np.ndarray, np.ndarray]:
        """(packed 4-grams, row of each): one for every letter and word gap; the contexts before a text's start are 0."""
        codes = _codes("".join(p for _, p in parts), self.table)
        lengths = np.array([len(p) for _, p in parts])
        part = np.repeat(np.arange(len(parts)), lengths)
        goes_on = parts[0][0] == self.row
        before = np.empty_like(codes)
        before[1:], before[:1] = codes[:-1], SPACE
        before[(np.cumsum(lengths) - lengths)[lengths > 0]] = SPACE  # drops spaces at a text's start
        if goes_on and len(codes):
            before[0] = self.before
        last = int(codes[-1]) if len(codes) else SPACE
        keep = (codes != SPACE) | (before != SPACE)
        codes, part = codes[keep], part[keep]
        at = np.arange(len(codes)) + (ORDER - 1) * (part + 1)
        line = np.zeros(len(codes) + (ORDER - 1) * (len(parts) + 1), np.uint64)
        line[at] = codes
        if goes_on:
            line[:ORDER - 1] = self.lead
        key = line[at]
        for k in range(1, ORDER):
            key = key | (line[at - k] << np.uint64(16 * k))
        own = line[np.searchsorted(part, len(parts) - 1) + (ORDER - 1) * (len(parts) - 1):]
        self.row, self.before = parts[-1][0], last
        self.lead = own[:len(own) - (ORDER - 1)][-(ORDER - 1):] if len(own) >= 2 * (ORDER - 1) else own[-(ORDER - 1):]
        return key, np.array([r for r, _ in parts])[part] if len(part) else part


def grams(parts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of whole texts."""
    return Grams(table)(parts)


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of ``docs`` (lang, text)."""

    def task(batches):
        table = letter_table()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            names, which = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True)
            held, read = {}, Grams(table)
            for parts in chunks(batch.column(1).to_pylist()):
                key, row = read(parts)
                lang = which[row] if len(row) else row
                for k in np.unique(lang):
                    g, n = np.unique(key[lang == k], return_counts=True)
                    if k in held:
                        g, back = np.unique(np.concatenate([held[k][0], g]), return_inverse=True)
                        n = np.bincount(back, np.concatenate([held[k][1], n])).astype(np.int64)
                    held[k] = (g, n)
            for k, (g, n) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[k]] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "gram", "n"])

    found = docs.select("lang", "text").mapInArrow(task, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """langs in sorted order; per order 4..1: packed n-grams (sorted) with log2 probabilities, and packed contexts
    (sorted) with log2 back-off weights, both with a column per language; ``limits``: rejection per language."""

    langs: list[str]
    keys: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    unseen: np.ndarray


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _log_probs(model: Model, key: np.ndarray, level: int) -> np.ndarray:
    """log2 probabilities (rows: keys, columns: languages) at an order; level 0 is the highest order."""
    if level == ORDER:
        return np.broadcast_to(model.unseen, (len(key), len(model.langs)))
    at = _lookup(model.keys[level], key)
    out = model.probs[level][at]
    miss = np.flatnonzero(at < 0)
    if len(miss):
        ctx = _lookup(model.contexts[level], key[miss] >> np.uint64(16))
        weight = np.where((ctx < 0)[:, None], np.float32(0), model.weights[level][ctx]) if len(
            model.contexts[level]) else np.float32(0)
        shorter = key[miss] & np.uint64((1 << 16 * (ORDER - 1 - level)) - 1)
        out[miss] = weight + _log_probs(model, shorter, level + 1)
    return out


def build(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney model from (language, packed 4-grams sorted, counts) per language."""
    langs = [r[0] for r in rows]
    per = []  # per language, per level: keys, counts
    for _, key, n in rows:
        levels = [(key, n.astype(float))]
        for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct longer n-grams with this ending
            g, c = np.unique(levels[-1][0] & np.uint64((1 << 16 * k) - 1), return_counts=True)
            levels.append((g, c.astype(float)))
        per.append(levels)
    none = np.zeros(0, np.uint64)
    alphabet = (len(np.unique(np.concatenate([p[-1][0] for p in per]))) if per else 0) + 1
    model = Model(langs, [none] * ORDER, [np.zeros((0, len(langs)), np.float32)] * ORDER, [none] * ORDER,
                  [np.zeros((0, len(langs)), np.float32)] * ORDER,
                  np.full(len(langs), -np.log2(alphabet), np.float32))
    for level in range(ORDER - 1, -1, -1) if per else ():
        keys = np.unique(np.concatenate([p[level][0] for p in per]))
        contexts = np.unique(keys >> np.uint64(16))
        shorter = keys & np.uint64((1 << 16 * (ORDER - 1 - level)) - 1)
        lower = 2.0 ** _log_probs(model, shorter, level + 1).astype(float)
        probs = np.zeros((len(keys), len(langs)), np.float32)
        weights = np.zeros((len(contexts), len(langs)), np.float32)
        of_key = _lookup(contexts, keys >> np.uint64(16))
        for k, levels in enumerate(per):
            g, c = levels[level]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            discount = float(np.clip(n1 / (n1 + 2 * n2) if n1 else 0.1, 0.1, 0.95))
            ctx = _lookup(contexts, g >> np.uint64(16))
            total = np.bincount(ctx, c, len(contexts))
            kinds = np.bincount(ctx, minlength=len(contexts))
            seen = total > 0
            back = np.where(seen, discount * kinds / np.where(seen, total, 1), 1.0)
            own = np.zeros(len(keys))
            own[_lookup(keys, g)] = np.maximum(c - discount, 0)
            p = own / np.where(seen, total, 1)[of_key] + back[of_key] * lower[:, k]
            probs[:, k] = np.log2(p)
            weights[:, k] = np.log2(back)
        model.keys[level], model.probs[level] = keys, probs
        model.contexts[level], model.weights[level] = contexts, weights
    return model


def score(texts, model: Model, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits per text and language, letters and gaps per text)."""
    bits = np.zeros((len(texts), len(model.langs)))
    n, read = np.zeros(len(texts), np.int64), Grams(table)
    for parts in chunks(texts):
        key, row = read(parts)
        if len(key):
            n += np.bincount(row, minlength=len(texts))
            logs = _log_probs(model, key, 0) if model.langs else None
            for k in range(len(model.langs)):
                bits[:, k] -= np.bincount(row, logs[:, k], len(texts))
    return bits, n


def _verdicts(bits: np.ndarray, n: np.ndarray, langs: list[str]) -> list[pa.Array]:
    """(language, score, cross-entropy, characters) per text from its bits in every language."""
    some = n > 0
    if langs:
        entropy = bits / np.maximum(n, 1)[:, None]
        best = entropy.argmin(1)
        low = entropy[np.arange(len(n)), best]
        gap = (entropy - low[:, None]) * np.minimum(n, 64)[:, None]
        sure = np.where(some, 1 / np.exp2(-gap).sum(1), 0.0)
        names = np.array(langs, dtype=object)[best]
        names[~some] = "und"
    else:
        low, sure = np.zeros(len(n)), np.zeros(len(n))
        names = np.array(["und"] * len(n), dtype=object)
    return [pa.array(list(names), pa.string()), pa.array(sure), pa.array(low), pa.array(n)]


def scored(docs: DataFrame, model: Model | Tables, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` (which has text) plus __lang_pred, __score, __bits (cross-entropy per character) and
    __chars; the score is 0 only for texts without language."""
    if isinstance(model, Tables):
        return _scored_by_join(docs, model, columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("__text"))

    def task(batches):
        m, table = shared.value, letter_table()
        for batch in batches:
            bits, n = score(batch.column(batch.num_columns - 1).to_pylist(), m, table)
            made = [*batch.columns[:-1], *_verdicts(bits, n, m.langs)]
            yield pa.RecordBatch.from_arrays(made, names=[f"c{k}" for k in range(len(made))])

    kinds = [T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)]
    new = [T.StringType(), T.DoubleType(), T.DoubleType(), T.LongType()]
    schema = T.StructType(kinds[:-1] + [T.StructField(f"c{len(columns) + k}", t) for k, t in enumerate(new)])
    return docs.toDF(*[f.name for f in kinds]).mapInArrow(task, schema).toDF(*columns, *SCORES)


@dataclass
class Tables:
    """The same model as written tables, for more counts than tasks should hold. The log2 probability of an n-gram is
    the unseen letter's plus one term per order for its context and one for itself, if the language has seen them;
    ``deltas`` holds these terms: kind, key, langs, terms."""

    langs: list[str]
    unseen: float
    deltas: DataFrame


def tabulate(counts: DataFrame) -> Tables:
    """Interpolated Kneser-Ney terms of all counts (lang, gram, n); ``build`` in Spark."""
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    names = counts.sparkSession.createDataFrame(list(enumerate(langs)), "l int, lang string")
    levels = [materialize(counts.join(names, "lang").select("l", F.col("gram").alias("key"),
                                                            F.col("n").cast("double").alias("c")), "char-level")]
    for k in range(ORDER - 1, 0, -1):
        ending = F.col("key").bitwiseAND(F.lit((1 << 16 * k) - 1).cast("long"))
        levels.append(materialize(levels[-1].groupBy("l", ending.alias("key")).agg(
            F.count(F.lit(1)).cast("double").alias("c")), "char-level"))
    alphabet = levels[-1].select("key").distinct().count() + 1
    parts, lower = [], None
    of = lambda n: F.sum((F.col("c") == n).cast("long"))
    for level in range(ORDER - 1, -1, -1):
        rows = levels[level].withColumn("ctx", F.shiftrightunsigned("key", 16))
        share = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.1)
        discounts = materialize(rows.groupBy("l").agg(of(1).alias("n1"), of(2).alias("n2")).select(
            "l", F.least(F.greatest(share, F.lit(0.1)), F.lit(0.95)).alias("d")), "char-discounts")
        contexts = rows.groupBy("l", "ctx").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
        contexts = materialize(contexts.join(discounts, "l").withColumn(
            "back", F.col("d") * F.col("kinds") / F.col("total")), "char-contexts")
        rows = rows.join(contexts, ["l", "ctx"])
        if lower is None:
            rows = rows.withColumn("low", F.lit(1.0 / alphabet))
        else:
            mask = F.lit((1 << 16 * (ORDER - 1 - level)) - 1).cast("long")
            rows = rows.withColumn("ending", F.col("key").bitwiseAND(mask)).join(
                lower.select("l", F.col("key").alias("ending"), F.col("p").alias("low")), ["l", "ending"])
        p = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("back") * F.col("low")
        lower = materialize(rows.select("l", "key", p.alias("p"), (
            F.log2(p) - F.log2("back") - F.log2("low")).alias("term")), "char-probabilities")
        parts += [lower.select(F.lit(2 * level).alias("kind"), "key", "l", "term"),
                  contexts.select(F.lit(2 * level + 1), "ctx", "l", F.log2("back"))]
    deltas = parts[0]
    for part in parts[1:]:
        deltas = deltas.unionAll(part)
    both = F.collect_list(F.struct("l", "term"))
    deltas = deltas.groupBy("kind", "key").agg(both.alias("b")).select(
        "kind", "key", F.col("b.l").alias("langs"), F.col("b.term").cast("array<float>").alias("terms"))
    return Tables(langs, float(-np.log2(alphabet)), materialize(deltas, "char-terms"))


def _kinds(grams: np.ndarray):
    """(kind, key of each 4-gram) of the terms that make up a 4-gram's log probability: per order itself and its context."""
    for level in range(ORDER):
        own = grams & np.uint64((1 << 16 * (ORDER - level)) - 1)
        yield 2 * level, own
        yield 2 * level + 1, own >> np.uint64(16)


def _packed(batches):
    """Rows (block, kind, key, data): the rows of a task in blocks of about BATCH bytes of text or GRAMS distinct 4-grams.
    Kind -1 has the block's rows, compressed; the others are the distinct (kind, key) of its texts. A text is never cut."""
    table, block = letter_table(), TaskContext.get().partitionId() << 32
    held, rows, size = np.zeros(0, np.uint64), [], 0

    def closed():
        sink, whole = pa.BufferOutputStream(), pa.Table.from_batches(rows).combine_chunks()
        packer = pa.Codec("zstd", compression_level=LEVEL)
        with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression=packer)) as out:
            out.write_table(whole)
        for kind, key in [(-1, np.zeros(1, np.uint64)), *((kind, np.unique(k)) for kind, k in _kinds(held))]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(key), block)), pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)),
                 pa.array([sink.getvalue().to_pybytes()] if kind < 0 else [None] * len(key), pa.binary())],
                names=["block", "kind", "key", "data"])

    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        length = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(length, dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // CHUNK)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if end == start:
                continue
            rows.append(batch.slice(start, end - start))
            size += int(length[start:end].sum())
            read = Grams(table)
            for parts in chunks(text[start:end].to_pylist()):
                held = np.union1d(held, read(parts)[0])
            if size >= BATCH or len(held) >= GRAMS:
                yield from closed()
                block, held, rows, size = block + 1, np.zeros(0, np.uint64), [], 0
    if rows:
        yield from closed()


class Terms:
    """The terms that a batch found, by kind in order of their keys."""

    def __init__(self, found: pa.Table, langs: int):
        self.langs = langs
        kind, key = found.column("kind").to_numpy(), found.column("key").to_numpy().view(np.uint64)
        self.lang, self.term = (found.column(c).combine_chunks().flatten().to_numpy() for c in ("langs", "terms"))
        self.many = pc.list_value_length(found.column("langs").combine_chunks()).to_numpy().astype(np.int64)
        self.start = np.cumsum(self.many) - self.many
        self.places = [own[np.argsort(key[own])] for own in (np.flatnonzero(kind == k) for k in range(2 * ORDER))]
        self.keys = [key[p] for p in self.places]

    def sums(self, grams: np.ndarray) -> np.ndarray:
        """The sum of a 4-gram's terms per language (rows: languages, columns: ``grams``)."""
        out = np.zeros(self.langs * len(grams))
        for kind, wanted in _kinds(grams):
            at = _lookup(self.keys[kind], wanted)
            column = np.flatnonzero(at >= 0)
            at = self.places[kind][at[column]]
            many = self.many[at]
            entry = np.arange(many.sum()) + np.repeat(self.start[at] - (np.cumsum(many) - many), many)
            # a language has one term of a kind and key, so no cell is met twice
            out[self.lang[entry].astype(np.int64) * len(grams) + np.repeat(column, many)] += self.term[entry]
        return out.reshape(self.langs, len(grams))


def _bits(texts, terms: Terms, unseen: float) -> tuple[np.ndarray, np.ndarray]:
    """(bits per text and language, letters and gaps per text) from the terms of all kinds and keys in the texts. Terms
    are added up once for each distinct 4-gram of a chunk, in slices of at most CELLS sums."""
    langs, read, n = terms.langs, Grams(letter_table()), np.zeros(len(texts), np.int64)
    logs = np.zeros((langs, len(texts)))
    step = max(1, CELLS // langs)
    for parts in chunks(texts):
        key, row = read(parts)
        if not len(key):
            continue
        rows, row = np.unique(row, return_inverse=True)
        n[rows] += np.bincount(row)
        kinds, which = np.unique(key, return_inverse=True)
        for at in range(0, len(kinds), step):
            sums = terms.sums(kinds[at:at + step])
            here = slice(None) if len(kinds) <= step else np.flatnonzero((which >= at) & (which < at + step))
            spot, text = which[here] - at, row[here]
            for k in range(langs):
                logs[k, rows] += np.bincount(text, sums[k][spot], len(rows))
    return -logs.T - n[:, None] * unseen, n


def _scored_by_join(docs: DataFrame, model: Tables, columns: list[str]) -> DataFrame:
    """``scored`` with a written model: each task packs its rows into compressed blocks, so that rows stay spread as they
    are, copies included; each block gets the terms of its own n-grams by a join, and its texts are scored with those."""
    langs, unseen = model.langs, model.unseen
    docs = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("__text"))
    docs = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    kinds = [*[f.dataType for f in docs.schema.fields[:-1]], T.StringType(), T.DoubleType(), T.DoubleType(), T.LongType()]
    schema = T.StructType([T.StructField(f"c{k}", t) for k, t in enumerate(kinds)])
    packed = materialize(docs.mapInArrow(_packed, "block long, kind int, key long, data binary"), "language-blocks")
    found = packed.filter("kind >= 0").select("block", "kind", "key").join(model.deltas, ["kind", "key"])

    def task(block, found):
        terms, out = Terms(found, len(langs)), []
        for rows in pa.ipc.open_stream(block.column("data")[0].as_buffer()):
            bits, n = _bits(rows.column(rows.num_columns - 1).to_pylist(), terms, unseen)
            out.append(pa.Table.from_arrays([*rows.columns[:-1], *_verdicts(bits, n, langs)], names=schema.names))
        return pa.concat_tables(out)

    blocks = packed.filter("kind < 0").select(F.col("block").alias("block"), "data")  # a column of its own for the cogroup
    scores = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(task, schema)
    return scores.toDF(*columns, *SCORES)


def train(documents: DataFrame, max_pairs: int = MAX_PAIRS) -> Model | Tables:
    """Model from all 4-grams of the learnable rows (doc_id, text, lang) that have a language: held by the tasks if at
    most ``max_pairs`` (language, 4-gram) counts and MAX_CELLS cells make it up, as written tables otherwise."""
    counts = materialize(count_grams(_learned(documents).select("lang", "text")), "char-grams")
    n_langs, pairs = counts.select("lang").distinct().count(), counts.count()
    if pairs > min(max_pairs, MAX_CELLS // max(n_langs, 1)):
        return tabulate(counts)
    kept = counts.toArrow()
    lang = np.array(kept.column("lang").to_pylist(), dtype=object).astype(str)
    gram, n = kept.column("gram").to_numpy().view(np.uint64), kept.column("n").to_numpy()
    per = []
    for name in np.unique(lang):
        own = lang == name
        order = np.argsort(gram[own])
        per.append((str(name), gram[own][order], n[own][order]))
    return build(per)


def _learned(documents: DataFrame) -> DataFrame:
    return documents.filter(learnable(F.col("doc_id")) & F.col("lang").isNotNull())


def _spread() -> Column:
    """Cross-entropies of short texts scatter more."""
    return F.sqrt(1 + 200 / F.greatest(F.col("__chars"), F.lit(1)))


def calibrate(scores: DataFrame, langs: list[str]) -> DataFrame:
    """(__of, __mean, __sd, __z) per language of the model: what the rejection limit is made of, from all ``scores`` (lang
    and SCORES of the learnable rows) whose language is predicted. Quantiles are taken of values rounded to GRID steps,
    so what one group holds is bounded. A language with fewer than FEW such rows takes the others' relative spread and
    largest quantile, and their middle if it has none; without any language of FEW rows there is no limit."""
    step = lambda c: F.round(c * GRID) / GRID
    hits = scores.filter("__chars > 0 AND __lang_pred = lang").select(F.col("lang").alias("__of"), "__bits", "__chars")
    per = hits.groupBy("__of").agg(
        F.percentile(step(F.col("__bits")), 0.5).alias("__mean"),
        F.greatest(F.stddev_pop("__bits"), 0.02 * F.avg("__bits")).alias("__sd"),
        F.count(F.lit(1)).alias("n"))
    per = materialize(per, "language-means")
    many = per.filter(F.col("n") >= FEW)
    z = (F.col("__bits") - F.col("__mean")) / (F.col("__sd") * _spread())
    tops = hits.join(many, "__of").groupBy("__of").agg(F.percentile(step(z), 0.999).alias("top"))
    own = many.join(tops, "__of").select("__of", "__mean", "__sd", F.greatest(F.lit(6.0), 1.5 * F.col("top")).alias("__z"))
    own = materialize(own, "language-limits")
    if not langs:
        return own
    names = scores.sparkSession.createDataFrame([(x,) for x in langs], "__of string")
    few = names.join(own, "__of", "left_anti").join(per.select("__of", F.col("__mean").alias("middle")), "__of", "left")
    others = own.agg(F.avg("__mean").alias("m"), F.avg(F.col("__sd") / F.col("__mean")).alias("s"), F.max("__z").alias("z"))
    mean = F.coalesce("middle", "m")
    # one row of averages
    few = few.crossJoin(others).filter("z IS NOT NULL").select("__of", mean.alias("__mean"), (mean * F.col("s")).alias("__sd"), F.col("z").alias("__z"))
    return materialize(own.unionByName(few), "language-limits")


def judged(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """``scores`` with __rejected."""
    far = F.col("__bits") > F.greatest(
        F.col("__mean") + F.col("__z") * F.col("__sd") * _spread(), FAR_ABOVE * F.col("__mean"))
    return scores.join(limits, F.col("__lang_pred") == F.col("__of"), "left").withColumn(
        "__rejected", (F.col("__score") == 0) | F.coalesce(far, F.lit(False)))


def language_id(documents: DataFrame) -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score, cross_entropy, rejected."""
    model = train(documents)
    scores = materialize(scored(documents, model, ["doc_id", "lang"]), "language-of-rows")
    out = judged(scores, calibrate(_learned(scores), model.langs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lang_pred").alias("lang_pred"),
                      F.col("__score").alias("score"), F.col("__bits").alias("cross_entropy"),
                      F.col("__rejected").alias("rejected"))


def accepted(documents: DataFrame) -> DataFrame:
    """The documents, same columns, that are not rejected; equal texts share their verdict, so texts are scored once
    and the documents meet only the keys of the rejected ones."""
    keyed = documents.withColumn("__t", text_key(F.col("text")))
    model = train(documents)
    scores = materialize(scored(keyed, model, ["doc_id", "lang", "__t"]), "language-of-rows")
    out = judged(scores, calibrate(_learned(scores), model.langs)).filter("__rejected").select("__t").distinct()
    return keyed.join(materialize(out, "language-rejected"), "__t", "left_anti").select(
        *[F.col(f"`{c}`") for c in documents.columns])
