"""Personal data: fixed patterns, and terms that corpus co-occurrence shows to disclose them.

Built-in functions only. Protected entities are the values that the base patterns find. The texts that have a
term, over all distinct texts of the corpus, tell how much it discloses of an entity: log2(p(e|t) / p(e)) out of
the -log2 p(e) bits that name the entity. Terms at or over ``disclose`` with enough support are generalised,
those at or over ``remove`` are removed, wherever they stand.

Defined results: null or empty text has no spans; a null doc_id and repeated rows keep a row each; an empty
table gives an empty result; columns besides doc_id and text are not read by ``pii`` and kept by ``sanitised``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_out, fresh, joined_spans, spans_of, stored

KINDS = ("email", "ip", "card", "phone", "term")
# The base patterns in a form that Java matches in linear time: a match can only start where a run of its
# first characters does, or right after the match before it; possessive runs never hold what follows them.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LETTER = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
TERM = LETTER + "+"
#: Code points on each side of an entity that tell its contexts apart.
REACH = 48
SPAN = "array<struct<ord:int,kind:string,s:int,e:int,bs:int,be:int,v:string,left:string,right:string>>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _small(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), _small)
    if kind == "card":
        return F.length(_digits(v)).between(12, 19) & F.call_function("luhn_check", _digits(v))
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


def _of_kind(text: Column, ord_: int, kind: str, pattern: str, sign: Column) -> Column:
    matches = F.filter(F.when(sign, spans_of(text, pattern, REACH + 1)), lambda x: _valid(kind, x["v"]))
    spans = F.transform(matches, lambda x: F.struct(F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), *(x[c].alias(c) for c in ("s", "e", "bs", "be", "v", "left", "right"))))
    return F.coalesce(spans, F.expr(f"cast(array() as {SPAN})"))


def base_spans(text: Column) -> Column:
    """All base spans of a text, kind by kind, each with its value and at most REACH + 1 code points beside it."""
    return F.concat(
        _of_kind(text, 0, "email", EMAIL, F.contains(text, F.lit("@"))), _of_kind(text, 1, "ip", IP, text.rlike(r"[0-9]\.[0-9]")),
        _of_kind(text, 2, "card", CARD, text.rlike("[0-9]")), _of_kind(text, 3, "phone", PHONE, F.contains(text, F.lit("+"))),
    )


def _key() -> Column:
    """Tells rows with findings apart; repeated rows share it, and their findings."""
    return F.xxhash64("doc_id", "text")


def _masked(text: Column) -> Column:
    """The text with its e-mail addresses as blanks, so that positions stay: other base spans have no letters."""
    both = F.zip_with(F.split(text, F.lit(EMAIL), -1), F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda gap, match: F.concat(gap, F.repeat(F.lit(" "), F.coalesce(F.octet_length(match), F.lit(0)))))
    return F.when(F.contains(text, F.lit("@")), F.array_join(both, "")).otherwise(text)


def _read(docs: DataFrame) -> DataFrame:
    """(doc_id, base_key, text_key, text, base) for each row of docs, a null text as an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", _key().alias("base_key"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.withColumn("base", base_spans(F.col("text")))


def _words() -> Column:
    """The distinct words outside of base spans as they are spelt."""
    return F.array_distinct(F.regexp_extract_all(_masked(F.col("text")), F.lit(TERM), F.lit(0)))


def disclosing(docs: DataFrame, found: DataFrame, disclose: float, support: int) -> DataFrame:
    """(term, bits): terms that disclose an entity, and the share of its bits that they tell, by all distinct texts of docs.

    found: (text_key, base, words) for each row, words where base has spans. A text has a term wherever it stands outside
    of base spans. Texts in which an entity stands in the same contexts are one witness: copies of a passage tell no more
    than one.
    """
    texts = found.where(F.size("base") > 0).groupBy("text_key").agg(F.first("base").alias("base"), F.first("words").alias("words"))
    one = texts.select("text_key", F.explode("base").alias("b"))
    one = one.select("text_key", F.lower("b.v").alias("entity"), F.xxhash64("b.v", "b.left", "b.right").alias("ctx"))
    held = stored(one.groupBy("text_key", "entity").agg(F.xxhash64(F.array_sort(F.collect_set("ctx"))).alias("ctx")))
    known = held.groupBy("entity", "ctx").agg(F.count(F.lit(1)).alias("n")).groupBy("entity").agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("n_ctx"))
    known = stored(known.where(F.col("n_ctx") >= support).select("entity", "n_e"))
    most = known.agg(F.max("n_e")).first()[0] or 0
    if not most:
        return docs.sparkSession.createDataFrame([], "term string, bits double")
    total = float(found.select("text_key").distinct().count())
    # A term in more texts than this tells less than enough, even if it stands in all those of the most frequent entity.
    bound = most ** disclose * total ** (1 - disclose) * (1 + 1e-9)
    lower = F.explode(F.array_distinct(F.transform("words", F.lower))).alias("term")
    # A row of a text that m rows have counts as 1 / m of it, so that only the few keys of repeated texts are joined.
    copies = stored(found.groupBy("text_key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    rows = _read(docs).select("text_key", _words().alias("words")).join(copies, "text_key", "left")
    count = rows.select(lower, (1.0 / F.coalesce("m", F.lit(1))).alias("share")).groupBy("term").agg(F.round(F.sum("share")).cast("long").alias("n_t"))
    count = stored(count.where(F.col("n_t").between(support, bound)))
    held = stored(held.join(known, "entity"))
    terms = texts.join(held.select("text_key").distinct(), "text_key", "left_semi").select("text_key", lower).join(count, "term")
    pair = held.join(stored(terms), "text_key").groupBy("entity", "term", "ctx").agg(F.count(F.lit(1)).alias("n"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    pair = pair.groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count(F.lit(1)).alias("n_ctx"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    told = pair.where((F.col("n_ctx") >= support) & (F.col("n_e") < total))
    told = told.withColumn("bits", F.log2((F.col("n_et") / F.col("n_t")) / (F.col("n_e") / total)) / -F.log2(F.col("n_e") / total))
    return told.where(F.col("bits") >= disclose).groupBy("term").agg(F.max("bits").alias("bits"))


def _places(docs: DataFrame, told: DataFrame, remove: float) -> DataFrame:
    """(text_key, terms): where the terms told stand, in each text that has one, beside an entity or not."""
    words = _read(docs).select("text_key", F.explode(_words()).alias("word")).withColumn("term", F.lower("word")).join(told, "term")
    hit = words.groupBy("text_key").agg(F.sort_array(F.collect_set(F.struct("word", (F.col("bits") >= remove).alias("whole")))).alias("hit"))
    rows = _read(docs).join(stored(hit), "text_key").withColumn("text", _masked(F.col("text")))
    any_word = F.concat(F.lit(f"(?<!{LETTER})(?:"), F.array_join(F.transform("hit", lambda x: x["word"]), "|"), F.lit(f")(?!{LETTER})"))
    act = F.map_from_entries("hit")
    terms = F.transform(spans_of(F.col("text"), any_word), lambda x: F.struct(
        F.lit(4).alias("ord"), F.lit("term").alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["bs"].alias("bs"), x["be"].alias("be"), F.when(act[x["v"]], F.lit("remove")).otherwise(F.lit("generalise")).alias("act")))
    return stored(rows.select("text_key", terms.alias("terms")).groupBy("text_key").agg(F.first("terms").alias("terms")))


def found_spans(docs: DataFrame, disclose: float = 0.85, remove: float = 0.97, support: int = 3) -> DataFrame:
    """(doc_id, base_key, base, terms) for each row of docs: base spans, and the disclosing terms wherever they stand.

    Base spans are written once, without texts; these are read again to count terms, and to place those that were found.
    """
    found = stored(_read(docs).select("doc_id", "base_key", "text_key", "base", F.when(F.size("base") > 0, _words()).alias("words")))
    told = stored(disclosing(docs, found, disclose, support))
    none = F.expr("cast(array() as array<struct<ord:int,kind:string,s:int,e:int,bs:int,be:int,act:string>>)")
    if told.isEmpty():
        return found.select("doc_id", "base_key", "base", none.alias("terms"))
    out = found.select("doc_id", "base_key", "text_key", "base").join(_places(docs, told, remove), "text_key", "left")
    return out.select("doc_id", "base_key", "base", F.coalesce("terms", none).alias("terms"))


def pii(docs: DataFrame, **how) -> DataFrame:
    """The contract's columns, and n_term: one row per row of docs."""
    found = found_spans(docs, **how)
    plain = lambda name: F.transform(name, lambda x: F.struct(x["ord"].alias("ord"), x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in KINDS[:4]), F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"),
        joined_spans(F.concat(plain("base"), plain("terms"))).alias("spans"), F.size(F.array_distinct(plain("terms"))).cast("long").alias("n_term"),
    )


def sanitised(docs: DataFrame, **how) -> DataFrame:
    """docs with personal data replaced by <KIND>, disclosing terms by <TERM> or nothing; n_chars follows.

    Texts without a finding are untouched, other columns too. Overlapping spans become one, named by the first.
    """
    columns = docs.columns
    id_, key, own, cuts = fresh(docs, "_id", "_key", "_own", "_cut")
    found = found_spans(docs, **how).where((F.size("base") > 0) | (F.size("terms") > 0))
    place = lambda x, to: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["ord"].alias("ord"), x["bs"].alias("bs"), x["be"].alias("be"), to.alias("to"))
    cut = F.concat(
        F.transform("base", lambda x: place(x, F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))),
        F.transform("terms", lambda x: place(x, F.when(x["act"] == "remove", F.lit("")).otherwise(F.lit("<TERM>")))),
    )
    # Repeated rows have the same findings.
    found = found.groupBy("doc_id", "base_key").agg(F.first("base", True).alias("base"), F.first("terms", True).alias("terms"))
    found = found.select(F.col("doc_id").alias(id_), F.col("base_key").alias(key), F.array_sort(cut).alias(cuts))
    both = docs.withColumn(own, _key()).join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(key)), "left")
    text = cut_out(F.col("text"), F.col(cuts))
    both = both.withColumn("text", F.when(F.col(cuts).isNull(), F.col("text")).otherwise(text))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        both = both.withColumn("n_chars", F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return both.select(*columns)
