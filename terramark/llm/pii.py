r"""PII and information-theoretic sanitisation. [native]

Base spans are matches of fixed patterns, leftmost and not overlapping within a kind: email, ip
(parts at most 255), card (13 to 19 digits passing Luhn), phone (9 to 15 digits). Matches that
fail their test are dropped without a second try. The patterns are written so that a run of
characters is entered once (possessive, started at its first character): long texts take linear
time and no stack.

The method adds spans of kind `term`. The values of base spans are the protected entities; all
counts are of distinct texts, so copies of a text are no evidence. A term occurs with an entity where
it lies wholly within CONTEXT code points of one of the entity's spans. Its disclosure is the
information that it gives about the entity as a share of the entity's own:
log(p(entity | term) / p(entity)) / -log p(entity). Most entities stand in one text, where the plain
estimate n_both / n_term is 1 for every word that is rare; so p(entity | term) is estimated from
below, as if the term had been seen `prior` more times without the entity. A term that occurs with
an entity in at least `min_support` texts and discloses at least `disclosure` of it is a quasi
identifier; it becomes a span wherever it stands in texts that hold the entity. `sanitised`
generalises a term that discloses several entities of its text to the name of its kind, and removes
one that gives away a single entity.

The search cuts exactly. Disclosure of at least t is the same as
n_term + prior <= n_both * (n_texts / n_entity) ** (1 - t), and a term's count within the texts that hold
entities is a lower bound of n_term: pairs that fail already with it never reach the scan of all documents. Each
scan sorts out other terms by a bitmap of BITS hashed bits before its shuffle; the joins are exact. A list of thousands of addresses pairs each with the words around it alone.

Defined cases: a null text counts as empty; documents without spans return empty strings and the
digest of the empty string; rows with a null id have base spans alone, but count among a term's
texts; rows that repeat an id are documents of their own; very long texts are searched whole;
extra columns are ignored, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import id_text, written

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Only texts with such a place are searched at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
MIN_SUPPORT, DISCLOSURE, PRIOR, CONTEXT = 1, 0.8, 2, 64
#: Bits of the bitmap of terms: 2**21 rows of 64 bits at most are broadcast, whatever the input.
BITS = 1 << 27
#: Code points of the blocks in which pieces of a text are found.
BLOCK = 256
SALTS = 8
TERM_SPLIT = r"[\x20\x09-\x0D]+"
TERM = r"^\p{L}[\p{L}\p{M}'-]*$"
#: Without bounds of length (the default), words of letters and digits.
ANY_TERM = r"^[\p{L}\p{N}][\p{L}\p{M}\p{N}'-]*$"
Bounds = tuple[int, int] | None


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's test."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def kind_spans(kind: str, text: Column) -> Column:
    """array<struct<kind, start, end, value>>: code points, end exclusive.

    The pieces between matches and the matches themselves add up to the positions.
    """
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("value"))
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,value:string>>)")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["value"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), pair["value"].alias("value"))
        more = F.when(_passes(kind, pair["value"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), more.alias("spans"))

    def fold(pairs: Column) -> Column:
        return F.aggregate(F.filter(pairs, lambda p: p["value"].isNotNull()), start, add, lambda s: s["spans"])

    return F.when(text.rlike(HINTS[kind]), fold(pairs)).otherwise(none)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and base (the spans of all kinds, in order) of (doc_id, text)."""
    return docs.select("doc_id", "text", F.concat(*[kind_spans(k, F.col("text")) for k in KINDS]).alias("base"))


def _edges(bounds: Bounds) -> tuple[str, str]:
    """The character classes of a term's first character, and of all that is stripped around it."""
    return (r"\p{L}", r"\P{L}") if bounds else (r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]")


def _terms(text: Column, bounds: Bounds = None) -> Column:
    around = _edges(bounds)[1]
    words = F.transform(F.split(text, TERM_SPLIT), lambda w: F.lower(F.regexp_replace(w, f"^{around}++|{around}++$", "")))
    if bounds is None:
        return F.array_distinct(F.filter(words, lambda w: w.rlike(ANY_TERM)))
    return F.array_distinct(F.filter(words, lambda w: F.length(w).between(*bounds) & w.rlike(TERM)))


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text in blocks: found among a few, not counted from its start."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, F.floor((F.greatest(end, start + 1) - 1) / BLOCK).cast("int") - first + 1), "")
    return F.substring(some, start % BLOCK + 1, end - start)


def contexts(text: Column, base: Column, bounds: Bounds = None, width: int = CONTEXT) -> Column:
    """array<struct<entity, terms>>: the terms wholly within `width` code points of each span."""
    def around(blocks: Column, s: Column) -> Column:
        left = _piece(blocks, F.greatest(s["start"] - (width + 1), F.lit(0)), s["start"])
        right = _piece(blocks, s["end"], s["end"] + (width + 1))
        # A word that reaches beyond the width shows by its character there, and goes.
        left = F.when(s["start"] > width, F.regexp_replace(left, r"^[^\x20\x09-\x0D]++", "")).otherwise(left)
        right = F.when(F.length(right) > width, F.regexp_replace(right, r"[^\x20\x09-\x0D]++$", "")).otherwise(right)
        return F.struct(s["value"].alias("entity"), _terms(F.concat_ws(" ", left, right), bounds).alias("terms"))

    # The blocks are an element, so that they are made once and not for each span.
    return F.transform(F.array(_blocks(text)), lambda blocks: F.transform(base, lambda s: around(blocks, s)))[0]


def _among(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of `df` whose term is one of those of `pairs`, and few others: no shuffle of `df`."""
    def placed(df: DataFrame) -> DataFrame:
        place = F.pmod(F.xxhash64("term"), F.lit(BITS))
        return df.withColumn("word", F.shiftright(place, 6)).withColumn("bit", (place % 64).cast("int"))

    bitmap = written(placed(pairs.select("term").distinct()).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")), "bitmap")
    return placed(df).join(F.broadcast(bitmap), "word").filter("shiftrightunsigned(bits, bit) & 1 = 1").drop("word", "bit", "bits")


def disclosing_terms(docs: DataFrame, min_support: int = MIN_SUPPORT, disclosure: float = DISCLOSURE, bounds: Bounds = None, prior: float = PRIOR) -> DataFrame:
    """(key, term, n): the quasi identifiers of each text and of how many of its entities.

    docs: doc_id, text, base (the spans) and key (the text's digest) of all documents.
    """
    n_texts = docs.select("key").distinct().count()
    held = docs.filter((F.size("base") > 0) & F.col("doc_id").isNotNull())
    near = held.select("key", F.explode(contexts(F.col("text"), F.col("base"), bounds)).alias("c"))
    seen = written(near.select("key", "c.entity", F.explode("c.terms").alias("term")).distinct(), "seen")
    owned = written(held.select("key", F.explode("base.value").alias("entity")).distinct(), "owned")
    entities = owned.groupBy("entity").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity") < n_texts)
    most = F.col("n_both") * F.pow(float(n_texts) / F.col("n_entity"), 1.0 - disclosure) * (1 + 1e-9)
    terms = lambda texts: texts.select("key", F.explode(_terms(F.col("text"), bounds)).alias("term"))
    counted = lambda df, name: df.select("key", "term").distinct().groupBy("term").agg(F.count("*").alias(name))
    pairs = seen.groupBy("entity", "term").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= min_support).join(entities, "entity")
    # Counts within contexts, then within texts that hold entities, then over all: each is a lower bound of the next.
    for name, texts in (("n_near", seen), ("n_held", held), ("n_term", docs)):
        among = texts if texts is seen else _among(terms(texts), pairs)
        pairs = written(pairs.join(counted(among, name), "term").filter(F.col(name) + prior <= most).select("entity", "term", "n_both", "n_entity"), name)
    own = _among(terms(held), pairs).distinct()
    return own.join(pairs.select("entity", "term"), "term").join(owned, ["key", "entity"]).groupBy("key", "term").agg(F.count("*").alias("n"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = MIN_SUPPORT,
             disclosure: float = DISCLOSURE, bounds: Bounds = None, prior: float = PRIOR) -> DataFrame:
    """One row per document: doc_id, text, base and terms (arrays of spans; a term's `value` is the
    action, `remove` or `generalise`). `bounds` are the least and greatest length of a term of letters;
    without them terms have any length and may hold digits."""
    keys = {"__row": F.monotonically_increasing_id(), "key": F.unhex(F.md5("text"))}
    found = written(base_spans(id_text(docs, id_col, text_col)).withColumns(keys), "spans")
    own = disclosing_terms(found, min_support, disclosure, bounds, prior).groupBy("key").agg(
        F.collect_list(F.struct("term", F.when(F.col("n") > 1, "generalise").otherwise("remove").alias("action"))).alias("own"))
    # Copies of one text may be a third of all rows, so its terms go to SALTS tasks.
    own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = found.filter((F.size("base") > 0) & F.col("doc_id").isNotNull()).select("__row", "key", F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int").alias("salt"))
    own = rows.join(own, ["key", "salt"]).select("__row", "own")
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,value:string>>)")
    owning = written(found.filter(F.size("base") > 0).join(own, "__row", "left").withColumn("own", F.map_from_entries("own")), "owning")
    spans = owning.withColumn("terms", F.when(F.col("own").isNull(), none).otherwise(term_spans(F.col("text"), F.col("own"), bounds)))
    # Written, since the digest reads the arrays several times and Spark would find the spans anew each time.
    spans = written(spans.withColumn("terms", apart("base", "terms")).select("doc_id", "text", "base", "terms"), "found")
    bare = found.filter(F.size("base") == 0).withColumn("terms", none)
    return spans.unionByName(bare.select("doc_id", "text", "base", "terms"))


def apart(base: str, terms: str) -> Column:
    """The spans of `terms` that overlap none of `base`, in two passes over both in order."""
    def marked(name: str | Column, own: bool) -> Column:
        return F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s.alias("span")))

    def swept(events: Column, edge: int, clear, moved) -> Column:
        start = F.struct(F.lit(edge).alias("edge"), F.expr("cast(array() as array<struct<kind:string,start:int,end:int,value:string>>)").alias("kept"))
        return F.aggregate(events, start, lambda acc, e: F.struct(
            F.when(e["own"], acc["edge"]).otherwise(moved(acc["edge"], e)).alias("edge"),
            F.when(e["own"] & clear(acc["edge"], e), F.concat(acc["kept"], F.array(e["span"]))).otherwise(acc["kept"]).alias("kept")), lambda acc: acc["kept"])

    ahead = swept(F.array_sort(F.concat(marked(base, False), marked(terms, True))), 0,
                  lambda edge, e: e["start"] >= edge, lambda edge, e: F.greatest(edge, e["end"]))
    back = swept(F.reverse(F.array_sort(F.concat(marked(base, False), marked(ahead, True)))), 2**31 - 1,
                 lambda edge, e: e["end"] <= edge, lambda edge, e: F.least(edge, e["start"]))
    return F.reverse(back)


def term_spans(text: Column, actions: Column, bounds: Bounds = None) -> Column:
    """Spans of the words whose stripped, lower-cased form is a key of `actions`, a column of its own
    (an expression would be built again for each word)."""
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,value:string>>)")
    first, around = _edges(bounds)
    pattern = first + r"[^\x20\x09-\x0D]*+"
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), words.alias("word"))

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        bare = F.regexp_replace(pair["word"], f"{around}++$", "")
        action = actions[F.lower(bare)]
        span = F.struct(F.lit("term").alias("kind"), begin.alias("start"), (begin + F.length(bare)).alias("end"), action.alias("value"))
        return F.struct((begin + F.length(pair["word"])).alias("at"), F.when(action.isNull(), state["spans"]).otherwise(F.concat(state["spans"], F.array(span))).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.aggregate(F.filter(pairs, lambda p: p["word"].isNotNull()), start, add, lambda s: s["spans"])


def kind_name(value: Column) -> Column:
    """What a term is generalised to: the kind of word it is."""
    return (F.when(value.rlike(r"^[\p{N}'-]+$"), "[number]").when(value.rlike(r"\p{N}"), "[code]")
            .when(value.rlike(r"^\p{Lu}"), "[name]").otherwise("[word]"))


def with_clean_text(found: DataFrame) -> DataFrame:
    """find_pii's rows with `clean`: base spans as [kind], terms generalised or removed."""
    every = F.array_sort(F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), s["kind"], F.lit("]")).alias("put"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["value"] == "remove", "").alias("put")))))
    # Where no later span reaches back: each span goes on from the largest end before it.
    ends = F.aggregate("__every", F.expr("cast(array(0) as array<int>)"), lambda acc, s: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), s["end"]))))

    def piece(start: Column, end: Column) -> Column:
        return _piece(F.col("__blocks"), start, end)

    def put(s: Column, i: Column) -> Column:
        at = F.get("__ends", i)
        return F.when(s["start"] >= at, F.concat(piece(at, s["start"]), F.coalesce(s["put"], kind_name(piece(s["start"], s["end"]))))).otherwise("")

    rows = found.withColumn("__every", every).withColumn("__blocks", _blocks(F.col("text")))
    rows = rows.withColumn("__ends", ends)
    rest = F.substring(F.col("text"), F.element_at("__ends", -1) + 1, F.length("text"))
    clean = F.concat(F.array_join(F.transform("__every", put), ""), rest)
    return rows.withColumn("clean", F.when(F.size("base") == 0, F.col("text")).otherwise(clean)).drop("__every", "__blocks", "__ends")


def sanitised(found: DataFrame) -> DataFrame:
    """(doc_id, clean) of find_pii's rows."""
    return with_clean_text(found).select("doc_id", "clean")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of find_pii's rows, then the number
    of terms removed and generalised and the digest of the sanitised text."""
    write = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    done = lambda action: F.size(F.filter("terms", lambda s: s["value"] == action)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return with_clean_text(found).select("doc_id", *counts, F.sha2(write(F.col("base")), 256).alias("base_sha256"),
                        write(F.concat("base", "terms")).alias("spans"), done("remove").alias("terms_removed"),
                        done("generalise").alias("terms_generalised"), F.sha2("clean", 256).alias("clean_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), bounds=None))
