"""Normalisation of user queries: codes, models, typo correction, term recognition and expansion. Queries are rows (query_id, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import fuzzy
from ..functions import text as T
from ..settings import SETTINGS
from ..sources.scratch import scratch_path, shared_dir


def synonyms(spark: SparkSession) -> DataFrame:
    """family, canonical, term, place."""
    return spark.createDataFrame(K.synonym_rows(), "family int, canonical string, term string, place int")


def term_frequency(texts: DataFrame, column: str = "text") -> DataFrame:
    """word, freq over all texts, of tokens of letters only."""
    return texts.select(F.explode(T.tokens(F.coalesce(F.col(column), F.lit("")))).alias("word")).where(~F.col("word").rlike("[0-9÷]")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def indexed_codes(texts: DataFrame, column: str = "text") -> DataFrame:
    return texts.select(F.explode(T.error_codes(F.coalesce(F.col(column), F.lit("")))).alias("code")).distinct()


def indexed_models(chunks: DataFrame) -> DataFrame:
    """compact, model: distinct models by compact key, in the spelling that comes first by pos."""
    keyed = chunks.where(F.col("model").isNotNull()).withColumn("compact", T.compact_key(F.col("model"))).where("compact != ''")
    return keyed.groupBy("compact").agg(F.min_by("model", "pos").alias("model"))


def error_codes(queries: DataFrame, codes: DataFrame) -> DataFrame:
    """query_id, code: codes in queries (query_id, text), and numbers after a word for error with the letter said or, without
    one, any indexed letter; only indexed codes count (code), unless there are none at all."""
    known = codes.select("code", F.lit(True).alias("indexed"))
    plain = queries.select("query_id", F.explode(T.error_codes(F.col("text"))).alias("code"))
    near = queries.select("query_id", F.inline(T.codes_in_context(F.col("text"))))
    said = near.where("letter != ''").select("query_id", F.concat("letter", "digits").alias("code"))
    letters = codes.select(F.substring("code", 1, 1).alias("l"), F.substring("code", 2, 9).alias("digits")).distinct()
    open_ = near.where("letter = ''").join(letters, "digits").select("query_id", F.concat("l", "digits").alias("code"))
    found = plain.unionByName(said).unionByName(open_).distinct().join(known, "code", "left")
    any_ = codes.agg((F.count(F.lit(1)) > 0).alias("some"))
    return found.join(F.broadcast(any_)).where(~F.col("some") | F.col("indexed")).select("query_id", "code")


def mentioned_model(queries: DataFrame, models: DataFrame) -> DataFrame:
    """query_id, model: the first, then shortest run of tokens whose concatenation is a model's compact key. Runs go on to the
    length of the longest key."""
    longest = models.agg(F.max(F.length("compact")).alias("longest")).where("longest > 0")
    toks = queries.select("query_id", T.tokens(F.col("text")).alias("t")).join(F.broadcast(longest))
    runs = toks.select("query_id", "t", "longest", F.explode(F.when(F.size("t") > 0, F.sequence(F.lit(1), F.size("t"))).otherwise(F.array().cast("array<int>"))).alias("start"))
    runs = runs.select("query_id", "t", "longest", "start", F.explode(F.sequence(F.lit(1), F.least("longest", F.size("t") - F.col("start") + 1))).alias("n"))
    runs = runs.select("query_id", "start", "n", "longest", F.array_join(F.slice("t", F.col("start"), F.col("n")), "").alias("compact")).where(F.length("compact") <= F.col("longest"))
    found = runs.join(models, "compact").withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy("start", "n", "compact")))
    return found.where("_k = 1").select("query_id", "model")


def exact_terms(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """query_id, term: vocabulary terms (term) that stand in the tokens (tokens) as whole words. A term of n words is looked up
    among the n-token runs, so this is an equality join; the vocabulary says which n there are."""
    sizes = vocabulary.select(F.size(F.split("term", " ")).alias("n")).distinct()
    runs = runs_of(queries.select("query_id", "tokens").join(F.broadcast(sizes)))
    return runs.join(vocabulary.select("term").distinct(), runs["gram"] == F.col("term")).select("query_id", "term").distinct()


#: Vocabularies up to this number of terms are run over texts as one automaton, larger ones are joined to their token runs.
MOST_AUTOMATON_TERMS = 200_000


def text_terms(texts: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, term: vocabulary terms (term) that stand in whole texts as whole words, each once. The vocabulary is sent to the tasks as
    one automaton that reads a text's tokens once, whatever the number of terms; nothing is shuffled. Null texts have no terms."""
    said = F.concat(F.lit(" "), F.array_join(T.tokens(F.coalesce(F.col(text_col), F.lit(""))), " "), F.lit(" "))
    known = vocabulary.select("term").where("term != ''").distinct()
    if known.count() > MOST_AUTOMATON_TERMS:
        return exact_terms(texts.select(F.col(id_col).alias("query_id"), T.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens")), known).withColumnRenamed("query_id", id_col)
    sent = texts.sparkSession.sparkContext.broadcast([r.term for r in known.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for term in sent.value:
            found.add_word(f" {term} ", term)
        if not len(found):
            return
        found.make_automaton()
        for b in batches:
            at, terms = [], []
            for k, text in enumerate(b.column(1)):
                own = sorted({t for _, t in found.iter(text.as_py())})
                at += [k] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string())], names=[id_col, "term"])

    return texts.select(id_col, said.alias("_said")).mapInArrow(run, f"`{id_col}` {texts.schema[id_col].dataType.simpleString()}, term string")


def ngrams(queries: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """query_id, start (from 0), n, gram: runs of n tokens for each n of an inclusive range."""
    return runs_of(queries.select("query_id", "tokens", F.explode(F.sequence(F.lit(sizes[0]), F.lit(sizes[1]))).alias("n")))


def runs_of(queries: DataFrame) -> DataFrame:
    """query_id, start (from 0), n, gram: runs of n tokens for rows (query_id, tokens, n)."""
    x = queries.where(F.size("tokens") >= F.col("n"))
    x = x.select("query_id", "tokens", "n", F.explode(F.sequence(F.lit(0), F.size("tokens") - F.col("n"))).alias("start"))
    return x.select("query_id", "start", "n", F.array_join(F.slice("tokens", F.col("start") + 1, F.col("n")), " ").alias("gram"))


def promotes_function_word(window: Column, match: Column) -> Column:
    """Whether a match of as many words differs from the window at a function word of the window."""
    pairs = F.zip_with(F.split(window, " "), F.split(match, " "), lambda a, b: (a != b) & a.isin(*K.FUNCTION_WORDS))
    return (F.size(F.split(window, " ")) == F.size(F.split(match, " "))) & F.exists(pairs, lambda x: F.coalesce(x, F.lit(False)))


#: Characters counted together in a signature; those of no class are not counted.
_CLASSES = ("e", "t", "a", "o", "i", "n", "s", "r", "h", "l", "d", "u", "c", "m", "fp", "gy", "wv", "bk", "jxqz", "01234", "56789")


def letter_signature(text: Column) -> Column:
    """63 bits: for each class of characters, as many of its three as the text has characters of it. A letter more or less
    changes a bit at most, so the differing bits of two texts are no more than insertions and deletions between them."""
    out = F.lit(0).cast("long")
    for k, chars in enumerate(_CLASSES):
        n = F.length(text) - F.length(F.translate(text, chars, ""))
        bits = F.when(n == 0, 0).when(n == 1, 1).when(n == 2, 3).otherwise(7).cast("long")
        out = out.bitwiseOR(F.shiftleft(bits, 3 * k))
    return out


def cut_lineage(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, made once and read again from a folder that all share, whose size plans can go by."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def most_edits(size: Column, other: Column, threshold: float) -> Column:
    """Insertions and deletions that a ratio of `threshold` leaves two texts of these lengths; as odd or even as their difference is."""
    d = F.floor((1 - threshold / 100) * (size + other) + 1e-9).cast("int")
    return d - F.pmod(d - F.abs(size - other), F.lit(2))


def best_matches(windows: DataFrame, vocabulary: DataFrame, threshold: float = SETTINGS.fuzzy_threshold, guard: bool = True) -> DataFrame:
    """The best vocabulary term for each distinct window (gram, n), at a ratio of `threshold` or more: gram, term, ratio.

    Terms have as many words as the window. A ratio leaves two texts of given lengths e insertions and deletions, so of e + 1 segments
    of the term one stands in the window as it is, no further from its place than the edits ahead of it and behind it allow: pairs
    meet by equality of segments, some four letters at the usual threshold. No pair at the threshold is lost. Letters are counted
    before the ratio is taken. Ties go to the term that comes first. A window whose best term would promote a function word has none,
    unless guard is off."""
    v = vocabulary.select("term", F.size(F.split("term", " ")).alias("n"), F.length("term").alias("size")).distinct().where("size > 0")
    v = v.withColumns({"v": letter_signature(F.col("term")), "places": F.when(F.col("size") <= fuzzy.MOST_BITS, fuzzy.letter_places(F.col("term")))})
    w = windows.select("gram", "n").where(F.length("gram") >= K.LEAST_WINDOW_CHARS).distinct().withColumn("w", letter_signature(F.col("gram")))
    letters, size = F.col("letters"), F.col("size")
    # Lengths that can meet, with the edits they have: as many rows as there are pairs of lengths.
    shapes = w.select("n", F.length("gram").alias("letters")).distinct().join(v.select("n", "size").distinct(), "n")
    shapes = shapes.where(200.0 * F.least(letters, size) >= threshold * (letters + size)).withColumn("e", most_edits(letters, size, threshold)).where("e >= 0")
    shapes = cut_lineage(shapes)
    segment = lambda k: F.floor(k * size / (F.col("e") + 1)).cast("int")  # noqa: E731  where the k-th one begins
    # With more edits than letters all segments may be gone, and one that is empty stands for the term.
    each = F.explode(F.sequence(F.lit(0), F.when(F.col("e") < size, F.col("e")).otherwise(0)))
    place = lambda df: df.withColumn("k", each).withColumns({"at": segment(F.col("k")), "long": segment(F.col("k") + 1) - segment(F.col("k"))})
    of_term = place(v.select("term", "n", "size").join(F.broadcast(shapes.select("n", "size", "e").distinct()), ["n", "size"]))
    of_term = of_term.select("term", "n", "size", "e", "k", F.substring("term", F.col("at") + 1, F.col("long")).alias("part"))
    of_window = place(w.select("gram", "n", F.length("gram").alias("letters")).join(F.broadcast(shapes), ["n", "letters"]))
    from_, to = F.greatest(-F.col("k"), letters - size - (F.col("e") - F.col("k"))), F.least(F.col("k"), letters - size + (F.col("e") - F.col("k")))
    from_, to = F.greatest(from_, -F.col("at")), F.least(to, letters - F.col("at") - F.col("long"))
    no_shift = F.col("long") == 0
    of_window = of_window.withColumns({"from": F.when(no_shift, 0).otherwise(from_), "to": F.when(no_shift, 0).otherwise(to)}).where("`from` <= `to`")
    of_window = of_window.select("gram", "n", "size", "e", "k", "at", "long", F.explode(F.sequence("from", "to")).alias("by"))
    of_window = of_window.select("gram", "n", "size", "e", "k", F.substring("gram", F.col("at") + F.col("by") + 1, F.col("long")).alias("part"))
    met = of_window.join(of_term, ["n", "size", "e", "k", "part"]).select("gram", "term", "n", "e").distinct()
    both = met.join(w, ["gram", "n"]).join(v, ["term", "n"])
    # Edits with replacements are no more than insertions and deletions, which the ratio counts.
    near = (F.bit_count(F.col("v").bitwiseXOR(F.col("w"))) <= F.col("e")) & (F.levenshtein("gram", "term") <= F.col("e"))
    lcs = F.when(F.col("places").isNotNull(), fuzzy.lcs_by_bits(F.col("gram"), F.col("term"), F.col("places"))).otherwise(fuzzy.lcs_length(F.col("gram"), F.col("term")))
    pairs = both.where(near).withColumn("ratio", 200.0 * lcs / (F.length("gram") + F.length("term"))).where(F.col("ratio") >= threshold)
    best = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("gram").orderBy(F.desc("ratio"), "term"))).where("_k = 1")
    best = best.where(~promotes_function_word(F.col("gram"), F.col("term"))) if guard else best
    return best.select("gram", "term", "ratio")


def greedy(candidates: DataFrame) -> DataFrame:
    """Of windows with a match (query_id, start, n, term) those that a pass over longer ones first, then left to right, takes
    while no token is used twice: query_id, start, n, term."""
    listed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "start", "term")))
    state = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<m:int,start:int,term:string>>").alias("taken"))

    def step(acc: Column, c: Column) -> Column:
        own = F.sequence(c["start"], c["start"] - c["m"] - 1)
        return F.when(F.arrays_overlap(acc["used"], own), acc).otherwise(F.struct(F.concat(acc["used"], own).alias("used"), F.concat(acc["taken"], F.array(c)).alias("taken")))

    rows = candidates.select("query_id", F.col("start").cast("int").alias("start"), F.col("n").cast("int").alias("n"), "term").groupBy("query_id").agg(listed.alias("c"))
    taken = rows.select("query_id", F.inline(F.aggregate("c", state, step, lambda s: s["taken"])))
    return taken.select("query_id", "start", (-F.col("m")).alias("n"), "term")


def expansion(terms: DataFrame, families: DataFrame) -> DataFrame:
    """The families of matched terms (query_id, term): query_id, term, place in the family; the first family that has a term counts."""
    own = families.groupBy("term").agg(F.min("family").alias("family"))
    return terms.join(own, "term").select("query_id", "family").distinct().join(families.select("family", F.col("term").alias("expanded"), "place"), "family").select("query_id", F.col("expanded").alias("term"), "family", "place")


#: Words of more letters meet by segments, shorter ones by forms with letters deleted.
MOST_DELETED_FROM = 20
#: Up to this number of forms of the asked words, some 20 MB, they are sent to the vocabulary's tasks; more are shuffled with its forms.
MOST_SENT_FORMS = 200_000
#: Two edits break four segments at most, as each swap has a letter in two.
SEGMENTS = 5


def corrections(tokens: DataFrame, manual: DataFrame, language: DataFrame) -> DataFrame:
    """word, corrected for the distinct words (word) that no vocabulary (word, freq) has: the nearest word of the manual within
    1 edit (up to 6 letters) or 2, by frequency, or one of the language that is strictly nearer. Words under 5 letters or with
    a digit stay as they are and don't appear, nor do words with nothing near.

    Candidates are found by equality joins that lose none: words of up to MOST_DELETED_FROM letters share a form with at most as many
    letters deleted as they may have edits, longer ones one of their five segments. Vocabularies are made once and written, without words
    whose length no asked word is near to; each word of them is looked at once. The exact distance, with swaps as one edit, is computed on
    what that finds. All in the JVM."""
    told = tokens.select("word").distinct().where((F.length("word") >= K.LEAST_CORRECTED_CHARS) & ~T.has_digit(F.col("word")))
    told = written(told, "asked-words")
    near_to = F.explode(F.sequence(F.length("word") - K.EDITS_LONG, F.length("word") + K.EDITS_LONG))
    lengths = told.select(near_to.alias("to_size")).distinct()  # as many rows as there are lengths of words
    vocab = manual.select(F.col("word").alias("to"), F.col("freq").cast("double").alias("freq"), F.lit(0).alias("list")).unionByName(language.select(F.col("word").alias("to"), F.col("freq").cast("double").alias("freq"), F.lit(1).alias("list")))
    fits = written(vocab.withColumn("to_size", F.length("to")).join(F.broadcast(lengths), "to_size"), "vocabulary")
    # Of a vocabulary only what is asked for is looked for, so that the larger side stays where it is.
    known = fits.select(F.col("to").alias("word")).join(told, "word", "left_semi")
    limit = F.when(F.length("word") <= K.SHORT_WORD_CHARS, K.EDITS_SHORT).otherwise(K.EDITS_LONG)
    asked = told.join(known, "word", "left_anti").select("word", limit.alias("limit"), F.length("word").alias("size"), letter_signature(F.col("word")).alias("ws"))
    asked = written(asked, "unknown-words")
    short = asked.where(F.col("size") <= MOST_DELETED_FROM)
    forms = deletions(short.where(F.col("limit") == K.EDITS_SHORT), "word", K.EDITS_SHORT).unionByName(deletions(short.where(F.col("limit") > K.EDITS_SHORT), "word", K.EDITS_LONG)).distinct()
    few = K.SHORT_WORD_CHARS + 1 - K.EDITS_LONG  # words with fewer letters are near to words with one edit only
    sizes = short.select(F.explode(F.sequence(F.col("size") - F.col("limit"), F.col("size") + F.col("limit"))).alias("to_size")).distinct()
    own = fits.join(F.broadcast(sizes), "to_size")
    own = deletions(own.where(F.col("to_size") < few), "to", K.EDITS_SHORT).unionByName(deletions(own.where(F.col("to_size") >= few), "to", K.EDITS_LONG))
    forms = written(forms, "forms")
    forms = F.broadcast(forms) if forms.count() <= MOST_SENT_FORMS else forms
    pairs = own.join(forms, "form").where(F.abs(F.col("size") - F.col("to_size")) <= F.col("limit")).withColumn("ts", letter_signature(F.col("to")))
    columns = ["word", "limit", "ws", "to", "freq", "list", "ts"]
    pairs = pairs.select(*columns).unionByName(segment_pairs(asked.where(F.col("size") > MOST_DELETED_FROM), fits.where(F.col("to_size") > MOST_DELETED_FROM - K.EDITS_LONG).withColumn("ts", letter_signature(F.col("to")))))
    # Written, as distances are long expressions, of which the driver would keep a copy for each step of a long plan.
    pairs = written(pairs.distinct().where(F.abs(F.length("word") - F.length("to")) <= F.col("limit")), "pairs")
    # As a generator the distance is taken once, where a filter's and a column's would be taken twice.
    near = pairs.withColumn("plain", F.when(F.length("word") <= 3 * MOST_DELETED_FROM, F.levenshtein("word", "to"))).where("plain is null or plain <= 2 * limit")
    near = near.select("word", "to", "freq", "list", F.explode(F.filter(F.array(edits()), lambda d: d <= F.col("limit"))).alias("d"))
    best = near.withColumn("_k", F.row_number().over(Window.partitionBy("word", "list").orderBy("d", F.desc("freq"), "to"))).where("_k = 1")
    # A word of the language wins only if strictly nearer.
    return best.withColumn("_k", F.row_number().over(Window.partitionBy("word").orderBy("d", "list"))).where("_k = 1").select("word", F.col("to").alias("corrected"))


def edits() -> Column:
    """fuzzy.near_distance of (word, to), which most pairs are spared: it is told by plain edits (plain; a swap is two of them) where
    there are few, and two edits that are three or four plain ones have a swap among them, which leaves letters (signatures ws, ts)
    what they are. Counting plain edits takes the square of the letters, so of very long words they are null."""
    differ, as_long = F.bit_count(F.col("ws").bitwiseXOR(F.col("ts"))), F.length("word") == F.length("to")
    out = F.when(F.col("plain") <= 1, F.col("plain")).when((F.col("plain") == 2) & (~as_long | (differ > 0)), 2)
    out = out.when((F.col("plain") > 4) | ((F.col("plain") == 4) & (~as_long | (differ > 0))) | ((F.col("plain") == 3) & (differ > 2)), fuzzy.FAR)
    return out.otherwise(fuzzy.near_distance(F.col("word"), F.col("to")))


def segment_pairs(asked: DataFrame, vocab: DataFrame) -> DataFrame:
    """word, limit, ws, to, freq, list, ts: words (word, limit, size, ws) with those (to, to_size, freq, list, ts) that have one of their segments at
    its place or up to two letters from it."""
    begin = lambda k: F.floor(k * F.col("size") / SEGMENTS).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)))
    cut = asked.select("word", "limit", "ws", "size", each.alias("k")).select("word", "limit", "ws", "size", "k", F.xxhash64(F.substring("word", begin(F.col("k")) + 1, begin(F.col("k") + 1) - begin(F.col("k")))).alias("part"))
    sizes = asked.select("size").distinct()
    at = vocab.select("to", "freq", "list", "ts", "to_size", F.explode(F.sequence(F.col("to_size") - K.EDITS_LONG, F.col("to_size") + K.EDITS_LONG)).alias("size")).join(F.broadcast(sizes), "size")
    at = at.select("to", "freq", "list", "ts", "size", each.alias("k")).select("*", F.explode(F.sequence(F.lit(-K.EDITS_LONG), F.lit(K.EDITS_LONG))).alias("by")).where(begin(F.col("k")) + F.col("by") >= 0)
    at = at.select("to", "freq", "list", "ts", "size", "k", F.xxhash64(F.substring("to", begin(F.col("k")) + F.col("by") + 1, begin(F.col("k") + 1) - begin(F.col("k")))).alias("part"))
    return cut.join(at, ["size", "k", "part"]).select("word", "limit", "ws", "to", "freq", "list", "ts")


def deletions(words: DataFrame, column: str, edits: int) -> DataFrame:
    """words with form: a row for each word with up to `edits` letters deleted, from left to right; the same form may come twice. As many as
    a power of the word's length, so for words of bounded length."""
    out = words.withColumns({"form": F.col(column), "_from": F.lit(0)})
    for _ in range(edits):
        # The place behind the last letter deletes nothing, and ends the word's turn.
        out = out.withColumn("_at", F.explode(F.sequence("_from", F.length("form"))))
        out = out.withColumn("form", F.concat(F.substr("form", F.lit(1), F.col("_at")), F.substr("form", F.col("_at") + 2))).withColumn("_from", F.col("_at"))
    return out.drop("_from", "_at")


def correct(queries: DataFrame, fixes: DataFrame) -> DataFrame:
    """queries (query_id, text, tokens) with corrected and corrections (before, after): tokens replaced where fixes (word,
    corrected) say so, except tokens with a digit. Nothing replaced leaves the raw text; else the tokens are joined by spaces."""
    each = queries.select("query_id", F.posexplode("tokens").alias("pos", "word")).join(fixes, "word", "left")
    each = each.withColumn("after", F.when(T.has_digit(F.col("word")), F.col("word")).otherwise(F.coalesce("corrected", "word")))
    rows = each.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "after"))).alias("t"))
    out = queries.join(rows, "query_id", "left")
    changed = F.filter("t", lambda x: x["word"] != x["after"])
    out = out.withColumn("corrections", F.coalesce(F.transform(changed, lambda x: F.struct(x["word"].alias("before"), x["after"].alias("after"))), F.array().cast("array<struct<before:string,after:string>>")))
    out = out.withColumn("corrected", F.when(F.size("corrections") > 0, F.array_join(F.transform("t", lambda x: x["after"]), " ")).otherwise(F.col("text")))
    return out.drop("t")


def normalise(queries: DataFrame, families: DataFrame, manual: DataFrame, language: DataFrame, codes: DataFrame, models: DataFrame) -> DataFrame:
    """The whole of it for queries (query_id, text): corrected, corrections, matched_terms (exact ones in alphabetical order, then
    fuzzy ones in window order), error_codes, expanded (corrected text, families' terms and codes, joined by " | "), firmware,
    model."""
    q = queries.withColumn("tokens", T.tokens(F.col("text")))
    fixes = written(corrections(q.select(F.explode("tokens").alias("word")), manual, language), "fixes")
    q = written(correct(q, fixes), "corrected")  # many parts below go by it
    now = q.select("query_id", T.tokens(F.col("corrected")).alias("tokens"))
    vocabulary = families.select("term")
    exact = exact_terms(now, vocabulary).select("query_id", F.lit(0).alias("kind"), F.lit(0).alias("n"), F.lit(0).alias("start"), "term")
    windows = ngrams(now, K.WINDOW_WORDS)
    found = written(greedy(windows.join(best_matches(windows, vocabulary), "gram").select("query_id", "start", "n", "term")), "fuzzy-terms")
    fuzzy_ = found.select("query_id", F.lit(1).alias("kind"), (-F.col("n")).alias("n"), "start", "term")
    listed = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("kind", "n", "start", "term"))), lambda x: x["term"]))
    matched = exact.unionByName(fuzzy_)
    terms = matched.groupBy("query_id").agg(listed.alias("matched_terms"))
    more = expansion(matched.select("query_id", "term"), families).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("family", "place", "term"))), lambda x: x["term"]).alias("more"))
    code = error_codes(queries, codes).groupBy("query_id").agg(F.sort_array(F.collect_set("code")).alias("error_codes"))
    empty = F.array().cast("array<string>")
    out = q
    for part in (terms, more, code, mentioned_model(queries, models)):
        out = out.join(part, "query_id", "left")
    out = out.withColumns({c: F.coalesce(c, empty) for c in ("matched_terms", "more", "error_codes")}).withColumn("firmware", T.firmware(F.col("text")))
    out = out.withColumn("expanded", F.array_join(F.array_distinct(F.concat(F.array("corrected"), "more", "error_codes")), " | "))
    return out.select("query_id", "text", "corrected", "corrections", "matched_terms", "error_codes", "expanded", "firmware", "model")
