"""Phrase collocations from a weighted de Bruijn graph of words.

The longest grams (three words) are edges from their first two words to their last two. Each task counts the
edges of blocks of two million words, and one shuffle by node adds them up. Shorter counts follow from the flow
of nodes: a pair of words occurs as often as its node has edges out of it, plus the times it ends a piece;
a word likewise, and the empty context (all words of a language) too; these two are summed before the
shuffle. Only nodes and edges of ``least`` occurrences or more go on.

Unary paths are compacted: where all that enters a node by one edge leaves it by one edge, the edges are joined.
Inner nodes of a path have its weight as their count, so only the junctions keep a row. Long repeated
passages become one row each. ``paths`` gives them; ``counts`` reads all shorter counts off paths and junctions.

A node with very many followers in a block is dealt out by its followers over ``SALTS`` parts and put together
again after they are combined; a mark tells the part of its other blocks. So no pair of words, however common,
lands in one task.

Cases: a NULL text has no words, a NULL language is ``und``; rows are counted as often as they occur, whatever their
ids. Ties rank by the phrase. An empty table, or one without repeated phrases, gives no rows. A text of any length
is split into blocks that overlap by two words. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.base import register, ship, table, trim
from paperloom.session import fits_broadcast, write_through

BLOCK = 2_000_000  # words that are counted at a time; below 2^21
BITS, SALTS = 21, 64
NONE = (1 << BITS) - 1
PIECES, SPACE = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
#: ``node`` is "words", for followers that are dealt out "words\r<part>", and behind a line break the language;
#: ``next`` is a word, empty for flow without a follower, and MARK for "this node is also dealt out".
GRAPH, MARK = "node string, next string, c long", "\r"


def _words(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """All words of a batch, the piece that each is from, and the language of each piece."""
    kind = pa.list_(pa.large_string())
    texts, langs = (batch.column(i).cast(pa.large_string()) for i in (0, 1))
    pieces = pc.split_pattern_regex(texts, PIECES).cast(pa.large_list(pa.large_string()))
    owner = pc.list_parent_indices(pieces)
    parts = pc.split_pattern_regex(pc.list_flatten(pieces), SPACE).cast(pa.large_list(kind.value_type))
    place, words = pc.list_parent_indices(parts), pc.list_flatten(parts)
    some = pc.not_equal(words, "")
    # ascii_lower misreads arrays that do not begin at their buffer, as cast slices do; filtered ones do.
    return pc.ascii_lower(words.filter(some)), place.filter(some).to_numpy(), langs.take(owner)


def _counted(words: pa.Array, piece: np.ndarray, langs: pa.Array, end: int) -> pa.RecordBatch:
    """Edges and flows of the grams that begin at the first ``end`` words, in order of their words."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    vocabulary, rank = coded.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    word, names = rank[coded.indices.to_numpy()], langs.dictionary_encode()
    # Ids of words within their language; they are fewer than the words of a block.
    pair, own = np.unique(names.indices.to_numpy()[piece].astype(np.int64) * len(vocabulary) + word, return_inverse=True)
    size = len(word)
    second, third = np.full(size, NONE, np.int64), np.full(size, NONE, np.int64)
    second[:-1], third[:-2] = np.where(piece[:-1] == piece[1:], own[1:], NONE), np.where(piece[:-2] == piece[2:], own[2:], NONE)
    edge = (own << (2 * BITS)) | (second << BITS) | third
    edge, weight = np.unique(edge[:end][second[:end] != NONE], return_counts=True)
    node, after = edge >> BITS, edge & NONE
    begin = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
    width = np.diff(np.append(begin, len(node)))
    crowded = width > max(16, size // 2000)
    text = vocabulary.take(pa.array(pair % len(vocabulary)))
    tongue = pc.binary_join_element_wise(pa.scalar("", text.type), names.dictionary.take(pa.array(pair // len(vocabulary))), pa.scalar("\n", text.type))

    def join(*parts) -> pa.Array:
        return pc.binary_join_element_wise(*parts, pa.scalar("", text.type))

    one, two = pa.array(node >> BITS), pa.array(node & NONE)
    following = text.take(pa.array(np.where(after == NONE, 0, after), mask=after == NONE)).fill_null("")
    suffix, crowd = np.full(len(node), "", object), np.flatnonzero(np.repeat(crowded, width))
    if len(crowd):  # by the follower itself: equal edges of all blocks meet
        suffix[crowd] = [f"{MARK}{xxhash.xxh32_intdigest(w) % SALTS}" for w in following.take(pa.array(crowd)).to_pylist()]
    pairs = pc.binary_join_element_wise(text.take(one), text.take(two), pa.scalar(" ", text.type))
    flow = np.bincount(own[:end], minlength=len(pair))
    used = np.flatnonzero(flow)
    total = np.bincount(names.indices.to_numpy()[piece[:end]], minlength=len(names.dictionary))
    spoken, marks = np.flatnonzero(total), pa.array(begin[crowded])
    rows = [
        (join(pairs, pa.array(suffix, text.type), tongue.take(one)), following, weight),
        (join(pairs.take(marks), tongue.take(one.take(marks))), [MARK] * len(marks), np.zeros(len(marks))),
        (join(text.take(pa.array(used)), tongue.take(pa.array(used))), [""] * len(used), flow[used]),
        (join(pa.scalar("\n", text.type), names.dictionary.take(pa.array(spoken))), [""] * len(spoken), total[spoken]),
    ]
    kinds = [pa.string(), pa.string(), pa.int64()]
    columns = [pa.concat_arrays([(v if isinstance(v, pa.Array) else pa.array(v)).cast(k) for v in part]) for part, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["node", "next", "c"])


def _edges(block: int):
    def run(batches):
        held: list[tuple] = []
        count = 0

        def flush():
            nonlocal held, count
            shift, places, part = 0, [], []
            for words, piece, langs in held:
                places.append(piece + shift)
                part.append(langs)
                shift += len(langs)
            words, piece, langs = pa.concat_arrays([w for w, _, _ in held]), np.concatenate(places), pa.concat_arrays(part)
            held, count = [], 0
            for at in range(0, len(words), block):
                found = _counted(words[at : at + block + 2], piece[at : at + block + 2], langs, min(block, len(words) - at))
                for start in range(0, len(found), 1 << 16):
                    yield found.slice(start, 1 << 16)
            trim()

        for batch in batches:
            words, piece, langs = _words(batch)
            if not len(words):
                continue
            if held and count + len(words) > block:
                yield from flush()
            held.append((words, piece, langs))
            count += len(words)
        if held:
            yield from flush()

    return run


def graph(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``edges`` (lang, node, next, c) and ``nodes`` (lang, node, flow) of at least ``least`` occurrences.

    Nodes are pairs of words, words, and the empty string, whose flow is the number of words.
    """
    ship(documents.sparkSession)
    rows = documents.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang")).where("text IS NOT NULL")
    combined = rows.mapInArrow(_edges(block), GRAPH).repartition("node").groupBy("node", "next").agg(F.sum("c").alias("c"))
    order = Window.partitionBy("node").orderBy("next")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = combined.select("node", "next", "c", F.sum("c").over(whole).alias("flow"), F.max(F.col("next") == MARK).over(whole).alias("hot"), (F.row_number().over(order) == 1).alias("first"))
    hot, told = F.col("hot") | F.col("node").contains(MARK), (F.col("next") != "") & (F.col("next") != MARK)
    marked = marked.withColumn("hot", hot).where(F.col("hot") | (F.col("first") & (F.col("flow") >= least)) | (told & (F.col("c") >= least)))
    words = F.substring_index("node", "\n", 1)
    told_in = F.expr("substring(node, instr(node, '\n') + 1)")  # all behind the first line break
    marked = write_through(marked.select(told_in.alias("lang"), F.substring_index(words, MARK, 1).alias("node"), "next", "c", "flow", "hot", "first"), "graph")
    cold, hot = marked.where("NOT hot"), marked.where("hot")
    edges = cold.where(told).select("lang", "node", "next", "c").unionAll(hot.where(told).groupBy("lang", "node", "next").agg(F.sum("c").alias("c")))
    nodes = cold.where("first").select("lang", "node", "flow").unionAll(hot.where("first").groupBy("lang", "node").agg(F.sum("flow").alias("flow")))
    return write_through(edges.where(F.col("c") >= least).withColumn("edge", F.monotonically_increasing_id()), "edges"), write_through(nodes.where(F.col("flow") >= least), "nodes")


def looked_up(rows: DataFrame, key: Column, known: DataFrame, name: str, value: str, salts: int = 4) -> DataFrame:
    """``rows`` with the count ``known`` (lang, phrase, f) has for a phrase; a common phrase is met in shares."""
    found = known.select("lang", F.col("phrase").alias("_phrase"), F.col("f").alias(name))
    rows = rows.withColumn("_phrase", key)
    if fits_broadcast(found):
        return rows.join(F.broadcast(found), ["lang", "_phrase"]).drop("_phrase")
    found = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)).cast("int")).join(found, ["lang", "_phrase", "_salt"]).drop("_phrase", "_salt")


def _last(node: str = "node", after: str = "next") -> Column:
    return F.concat_ws(" ", F.substring_index(node, " ", -1), F.col(after))


def paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Compacted edges: ``lang, words, c``; every edge is in one path, between neighbouring words.

    Edges meet at a node whose whole flow enters by the one and leaves by the other. Pointers to the
    edge before are doubled, and paths that have found their head take no further part; there are as many
    rounds as the longest path has binary digits. A path is no longer than the longest text.
    """
    flows = nodes.where("node LIKE '% %'")
    into = edges.select("lang", _last().alias("node"), F.col("edge").alias("before"), "c")
    into = into.join(flows, ["lang", "node"]).where("c = flow").select("lang", "node", "before")
    out = edges.join(flows, ["lang", "node"]).where("c = flow").select("lang", "node", "edge")
    state = edges.select("edge").join(into.join(out, ["lang", "node"]).select("edge", "before"), "edge", "left")
    state = state.select("edge", "before", F.when(F.col("before").isNull(), F.col("edge")).alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("far"))
    state = write_through(state, "chains")
    while state.where("head IS NULL").head(1):
        up = state.select(F.col("edge").alias("before"), F.col("before").alias("further"), F.col("head").alias("top"), F.col("far").alias("more"))
        open_ = state.where("head IS NULL").drop("head").join(up, "before").select("edge", F.col("further").alias("before"), F.col("top").alias("head"), (F.col("far") + F.col("more")).alias("far"))
        state = write_through(state.where("head IS NOT NULL").unionAll(open_), "chains")
    steps = edges.join(state.select("edge", "head", "far"), "edge").groupBy("head")
    steps = steps.agg(F.first("lang").alias("lang"), F.first("c").alias("c"), F.min_by("node", "far").alias("node"), F.array_sort(F.collect_list(F.struct("far", "next"))).alias("s"))
    return steps.select("lang", F.concat(F.split("node", " "), F.col("s.next")).alias("words"), "c")


def counts(compact: DataFrame, nodes: DataFrame) -> DataFrame:
    """``lang, phrase, size, f`` of words, pairs and triples, from compacted paths and the flow of junctions."""

    def grams(size: int, first: int) -> DataFrame:
        """Phrases of a path from word ``first`` to as many words before its end."""
        places = F.sequence(F.lit(first), F.size("words") - size - first)
        some = compact.where(F.size("words") >= size + 2 * first)
        phrase = F.transform(places, lambda i: F.array_join(F.slice("words", i + 1, F.lit(size)), " "))
        return some.select("lang", F.explode(phrase).alias("phrase"), F.lit(size).alias("size"), F.col("c").alias("f"))

    inner = grams(2, 1)
    pairs, words = (nodes.where(test).select("lang", F.col("node").alias("phrase"), F.lit(size).alias("size"), F.col("flow").alias("f")) for test, size in (("node LIKE '% %'", 2), ("node <> '' AND node NOT LIKE '% %'", 1)))
    junctions = pairs.join(inner.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    return grams(3, 0).unionAll(inner).unionAll(junctions).unionAll(words)


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, cover: int = 50, top: int = 2000, block: int = BLOCK) -> DataFrame:
    """The ``top`` phrases of two and three words of each language by the weakest of their cuts.

    ``lang, rank, phrase, a, l, r, n, score`` as the query returns them. A phrase of which a longer candidate
    covers ``cover`` per cent is left out. Products are decimals of 38 digits.
    """
    edges, nodes = graph(documents, text, lang, least, block)
    known = write_through(counts(paths(edges, nodes), nodes), "counts")
    candidates = known.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    parts = known.where("size < 3")
    cuts = looked_up(candidates, F.expr("substring_index(phrase, ' ', k)"), parts, "l", "phrase")
    cuts = looked_up(cuts, F.expr("substring_index(phrase, ' ', k - size)"), parts, "r", "phrase")
    whole = lambda name: f"CAST({name} AS DECIMAL(16,0))"
    score = F.expr(f"(CAST({whole('a')} * {whole('a')} AS DECIMAL(31,0)) * CAST(1000000 AS DECIMAL(7,0))) DIV ({whole('l')} * {whole('r')})")
    weakest = cuts.groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    longer = known.where("size = 3")
    longer = longer.select("lang", F.substring_index("phrase", " ", 2).alias("phrase"), "f").unionAll(longer.select("lang", F.substring_index("phrase", " ", -2).alias("phrase"), "f"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(F.col("held").isNull() | (F.col("held") * 100 < F.col("a") * cover))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*best)
    kept = kept.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    sizes = nodes.where("node = ''").select("lang", F.col("flow").alias("n"))
    kept = kept.join(F.broadcast(sizes) if fits_broadcast(sizes) else sizes, "lang")
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(unnest(string_split_regex(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda w: w <> '') AS w
    FROM documents
), grams AS (
    SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
    FROM pieces, (VALUES (1), (2), (3)) s(size)
), f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), cuts AS (
    SELECT lang, size, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS h, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS t
    FROM f, (VALUES (1), (2)) s(k) WHERE f >= 10 AND k < size
), scored AS (
    SELECT c.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.h JOIN f y ON y.lang = c.lang AND y.phrase = c.t
), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
    SELECT * FROM weakest s WHERE NOT EXISTS (
        SELECT 1 FROM (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[:2], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS part FROM f WHERE size = 3 AND f >= 10) x
        WHERE x.lang = s.lang AND x.part = s.phrase AND 100 * x.f >= 50 * s.a)
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN n ON n.lang = k.lang QUALIFY rank <= 2000
"""


@register("op12_collocations", SQL)
def op12_collocations(spark, folder):
    """The strongest phrases of each language."""
    return collocations(table(spark, folder, "documents"))
