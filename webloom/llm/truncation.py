"""Text cut off by field limits (problem 10), in SQL expressions only.

Every word trigram of the corpus is counted inside sentences (another word follows), at ends
that carry a sentence's last sign, and at bare ends (a line ends with it, no sign).  A text
whose last trigram is common in the first two places but almost never a bare end was cut off
there.  A last word that is only the beginning of a word is matched against the words that
follow the same two words elsewhere.  Where no text has the trigram, its last two words decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.sources.tables import cut

# Signs that end a sentence, signs that may close it, and marks put at a cut.
ENDS = r"[.!?。！？]"
CLOSERS = r"""['"”’»)\]]"""
#: A broken sign at the very end: an unfinished tag, entity or escape, or replacement characters.
BROKEN_TAIL = r"(?:<(?:[A-Za-z/!][^<>\n]*)?|&(?:#x?[0-9A-Fa-f]{0,6}|[a-z]{0,6})|\\u?[0-9A-Fa-f]{0,4}|\x{FFFD}+)$"
CUT_MARK = (
    r"\s*(?:\((?:more|mehr|suite|más|mais|meer|więcej|ещё|далее|続き)\)|\[(?:\.\.\.|…)\]|(?:\.\.\.|…)»?|»|→|>>"
    r"|(?:\.\.\.|…)?\s*(?:Read more|Continue reading|Weiterlesen|Lire la suite|Leer más|Ler mais|Lees meer|Czytaj dalej|Читать далее|続きを読む))\s*$"
)
#: Scripts without spaces: each run of one kind of sign counts as a word.
_RUNS = r"([\x{3040}-\x{309F}]+|[\x{30A0}-\x{30FF}]+|[\x{3400}-\x{9FFF}\x{3005}]+)"
_SIGN = "\x03"
_PAD = "\x02"
_LINE = "\x04"
_SMILEY = r"\s[:;]-?[)D]$"
#: A web or mail address or a tag at the end says nothing about the sentence.
_ADDRESS = r"(?:^|\s)(?:[a-z]+://\S+|www\.\S+|#\S+|@\S+|\S+@\S+)$"


#: Whatever parts words: all signs that are neither letters nor the marks above.
_APART = r"[^\p{L}\x{02}-\x{04}]+"


def _tokens(text: Column) -> Column:
    """Words of the text; a sentence's last sign is a token, a bare line end another, each followed by two pads.

    Digits and other signs only part words; in scripts without spaces each run of one kind of
    sign is a word.
    """
    start = f" {_PAD} {_PAD} "
    unspaced = F.octet_length(text) > 2 * F.length(text)
    t = F.when(unspaced, F.replace(text, F.lit("。"), F.lit("。 "))).otherwise(text)
    t = F.regexp_replace(t, f"{ENDS}{CLOSERS}*(?:[ \n\t\r]|$)", f" {_SIGN}{start}")
    t = F.replace(t, F.lit("\n"), F.lit(f" {_LINE}{start}"))
    t = F.when(unspaced, F.regexp_replace(t, _RUNS, " $1 ")).otherwise(t)
    return F.split(F.concat(F.lit(start[1:]), F.trim(F.regexp_replace(t, _APART, " "))), " ")


def ends_of(documents: DataFrame) -> DataFrame:
    """The last sentence of each document that isn't blank: ``doc_id, source, copy, broken, bullet, comma, open, c1, c2, tail``.

    ``broken``: the last sign is damaged; ``open``: no sign ends the sentence once marks put at
    a cut are taken off, nor an address; ``comma``: a sign that asks for more text ends it; ``bullet``: the last
    line is a list item; c1 and c2 are the words before the last word ``tail``.
    """
    text = F.rtrim(F.coalesce(F.col("text"), F.lit("")), F.lit(" \n\t\r"))
    df = documents.select("doc_id", "source", F.xxhash64("text").alias("copy"), F.substring_index(text, "\n", -1).alias("line")).where((F.col("line") != "") & F.col("doc_id").isNotNull())
    df = df.withColumn("broken", F.col("line").rlike(BROKEN_TAIL))
    df = df.withColumn("line", F.regexp_replace(F.regexp_replace("line", BROKEN_TAIL, ""), CUT_MARK, ""))
    df = df.withColumn("open", ~F.regexp_replace("line", _SMILEY, "").rlike(f"{ENDS}{CLOSERS}*\\s*$|{_ADDRESS}"))
    df = df.withColumn("comma", F.col("line").rlike(r"[,;:、(–€$]\s*$")).withColumn("bullet", F.col("line").rlike(r"^\s*[-*•·–]\s"))
    # three words at the very end decide: mostly the line's last 600 signs hold them, else all of it is read
    read = lambda text: F.concat(F.array(F.lit(_PAD)), F.filter(_tokens(text), lambda w: w != ""))
    df = df.withColumn("w", read(F.substring("line", -600, 600)))
    df = df.withColumn("w", F.when((F.length("line") <= 600) | (F.size("w") >= 7), F.col("w")).otherwise(read(F.col("line"))))
    return df.select("doc_id", "source", "copy", "broken", "bullet", "comma", "open", F.element_at("w", -3).alias("c1"), F.element_at("w", -2).alias("c2"), F.element_at("w", -1).alias("tail"))


def trigram_counts(documents: DataFrame) -> DataFrame:
    """``context, c2, word, inside, signed, bare`` of every trigram of every document.

    ``context`` is the 64-bit hash of the two words before ``word``; c2 is the nearer one.
    """
    p = documents.select(_tokens(F.coalesce(F.col("text"), F.lit(""))).alias("p")).withColumn("n", F.size("p"))
    zipped = F.arrays_zip(F.col("p").alias("c1"), F.slice("p", 2, F.col("n")).alias("c2"), F.slice("p", 3, F.col("n")).alias("word"), F.slice("p", 4, F.col("n")).alias("next"))
    flat = p.select(F.inline(zipped)).toDF("c1", "c2", "word", "next").where(~F.col("word").isin("", _PAD, _SIGN, _LINE))
    place = F.when(F.col("next") == _SIGN, 1).when(F.col("next").isNull() | F.col("next").isin("", _LINE), 2).otherwise(0)
    flat = flat.select(F.xxhash64("c1", "c2").alias("context"), "c2", "word", place.alias("place"))
    count = lambda place: F.sum((F.col("place") == place).cast("bigint"))
    return flat.groupBy("context", "c2", "word").agg(count(0).alias("inside"), count(1).alias("signed"), count(2).alias("bare"))


#: Sorts after every other sign.
_LAST = "\U0010ffff"


def _evidence(suspects: DataFrame, grams: DataFrame, keys: list[str], name: str) -> DataFrame:
    """For each last word after its context: occurrences as a whole word, and of longer words it begins.

    In the order of words, those that begin with a last word follow it at once: running sums of
    the occurrences before and after that range give them, so that no last word meets a word.
    """
    group = [*keys, "initial"]
    initial = lambda c: F.substring(c, 1, 1).alias("initial")
    copies = suspects.groupBy(*keys, "tail", "copy").agg(F.count("*").alias("copies"))
    own = copies.groupBy(*keys, "tail").agg(F.max("copies").alias(f"{name}_own")).select("*", initial("tail"))
    place = lambda text, rank: F.struct(text.alias("text"), F.lit(rank).alias("rank"))
    tail = F.col("tail")
    zero = F.lit(0).cast("bigint")
    ends = own.select(*group, "tail", f"{name}_own", F.explode(F.array(place(tail, 0), place(tail, 2), place(F.concat(tail, F.lit(_LAST)), 3))).alias("p"))
    ends = ends.select(*group, "tail", f"{name}_own", "p.*", zero.alias("used"), zero.alias("bare"))
    words = grams.select(*keys, "word", initial("word"), (F.col("inside") + F.col("signed")).alias("used"), "bare").join(own.select(*group).distinct(), group, "left_semi")
    words = words.select(*group, F.lit(None).cast("string").alias("tail"), F.lit(None).cast("bigint").alias(f"{name}_own"), F.col("word").alias("text"), F.lit(1).alias("rank"), "used", "bare")
    before = Window.partitionBy(*group).orderBy("text", "rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = words.unionByName(ends).withColumn("used", F.sum("used").over(before)).withColumn("bare", F.sum("bare").over(before)).where(tail.isNotNull())
    at = lambda column, rank: F.max(F.when(F.col("rank") == rank, F.col(column)))
    return summed.groupBy(*keys, "tail", f"{name}_own").agg((at("used", 2) - at("used", 0)).alias(f"{name}_whole"), (at("bare", 2) - at("bare", 0)).alias(f"{name}_bare"), (at("used", 3) - at("used", 2)).alias(f"{name}_longer"))


def truncated(documents: DataFrame, least: int = 2, most_bare: float = 0.05, fragment_ratio: int = 20, alone_least: int = 20) -> DataFrame:
    """One row a document: ``doc_id, source, truncated``.

    Truncated is a document whose last sign is broken, or that ends without a sentence's last
    sign where (a) its last trigram stands at least ``least`` times elsewhere inside sentences or
    before a last sign and, of all places, in at most ``most_bare`` at bare ends of other texts, or
    (b) its last word only begins words that follow the same two words elsewhere, at least
    ``fragment_ratio`` times as often as the last word itself.  The last bigram decides where no
    other text has the trigram, and the last word where none has the bigram: one seen
    ``alone_least`` times but hardly ever at a bare end, or no word but the start of some.  List items are held against (b) only.  Null and blank texts are
    not truncated; null ids are left out; rows delivered twice count once; copies of a cut text
    don't count as bare ends of other texts.
    """
    documents = documents.select("doc_id", "source", "text")
    ends = cut(ends_of(documents).dropDuplicates(["doc_id"]).withColumn("context", F.xxhash64("c1", "c2")))
    suspects = ends.where(F.col("open") & ~F.col("broken") & (F.col("tail") != _PAD))
    grams = cut(trigram_counts(documents))
    three = _evidence(suspects, grams.select("context", "word", "inside", "signed", "bare"), ["context"], "t")
    pairs = grams.groupBy("c2", "word").agg(F.sum("inside").alias("inside"), F.sum("signed").alias("signed"), F.sum("bare").alias("bare"))
    two = _evidence(suspects, pairs, ["c2"], "b")
    one = _evidence(suspects, pairs.groupBy("word").agg(F.sum("inside").alias("inside"), F.sum("signed").alias("signed"), F.sum("bare").alias("bare")), [], "u")
    scored = suspects.join(three, ["context", "tail"], "left").join(two, ["c2", "tail"], "left").join(one, "tail", "left").fillna(0)

    def decide(name: str, least: int) -> Column:
        whole, longer = F.col(f"{name}_whole"), F.col(f"{name}_longer")
        others = F.greatest(F.col(f"{name}_bare") - F.col(f"{name}_own"), F.lit(0))
        whole_word = ~F.col("bullet") & (whole >= least) & (others <= most_bare * (whole + others))
        fragment = (longer >= 1) & (longer >= fragment_ratio * (whole + others))
        return whole_word | fragment | (F.col("comma") & (whole + longer > 0))

    known = F.col("t_whole") + F.col("t_longer") > 0
    # after a word that stands nowhere else, the last word's own places decide
    alone = ~F.col("bullet") & (F.col("c2") != _PAD) & (F.col("b_whole") + F.col("b_longer") == 0)
    never_last = (F.col("u_whole") >= alone_least) & (F.greatest(F.col("u_bare") - F.col("u_own"), F.lit(0)) <= 0.01 * F.col("u_whole"))
    no_word = (F.col("u_whole") + F.greatest(F.col("u_bare") - F.col("u_own"), F.lit(0)) == 0) & (F.col("u_longer") >= alone_least) & F.col("tail").rlike(r"^\p{Ll}")
    decided = scored.withColumn("truncated", F.when(known, decide("t", least) | ((F.col("t_whole") == 1) & decide("b", least))).otherwise(((F.col("c2") != _PAD) & decide("b", least + 1)) | (alone & (never_last | no_word))))
    rest = ends.where(~(F.col("open") & ~F.col("broken") & (F.col("tail") != _PAD))).select("doc_id", "source", F.col("broken").alias("truncated"))
    return decided.select("doc_id", "source", "truncated").unionByName(rest)


def truncation_rates(flags: DataFrame) -> DataFrame:
    """How often each source truncates: ``source, documents, truncated_documents, rate``."""
    return flags.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("truncated").cast("bigint")).alias("truncated_documents")).withColumn(
        "rate", F.col("truncated_documents") / F.col("documents")
    )
