"""Information-theoretic sanitisation: personal data, and the terms that reveal it.

Base matches (e-mail, IP, card, phone) and secrets (long runs of letters and digits)
are the protected values. Values that stand together in documents are one person's:
an entity is such a group, and each kind of value is an entity too. Corpus counts say
how much of an entity's information a term gives away, counting documents throughout:

    disclosure(t; e) = PMI(t; e) / IC(e) = log2(n(e,t) N / (n(e) n(t))) / log2(N / n(e))

It is 1 when the term occurs in documents of the entity only. Terms from ``REMOVE``
on are removed, those from ``GENERALISE`` on are generalised. Both need to stand with
the entity in ``SUPPORT`` different texts, as copies of one text say nothing about a
term, and in a share of the entity's documents (``OF_PERSON`` or ``OF_KIND``), so that
rare words that happen to stand beside personal data are left. Ratios alone decide, so
that the size of the corpus does not. All places of a term in the entity's documents are
hidden; a removed term of a person's is hidden in all documents.
All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.functions.arrays import let, running_sums
from hexloom.operators.components import connected_components
from hexloom.session import cut_lineage, release

REMOVE, GENERALISE, SUPPORT = 0.95, 0.7, 3
#: Least share of a person's or a kind's documents that a term stands in.
OF_PERSON, OF_KIND = 0.1, 0.5
#: Most rows of a term table that are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
KINDS = ["email", "ip", "card", "phone"]
# Words; of those of up to three letters the capitalised ones and those of scripts without case, so that short names count and particles do not.
_TERM = r"(?<!\p{L})(?:\p{L}{4,}|\p{Lu}\p{L}{1,2}|\p{Lo}{1,3})(?!\p{L})"
_LOCAL = "[A-Za-z0-9._%+-]"
# As the contract's patterns, with possessive repeats (nothing that follows could use what they hold) so
# that long runs need no stack, and e-mail names and IPs tried from the start of a run (or the end of the last match) only.
_PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A run of at least 20 letters, digits and underscores with four digits and a letter.
_SECRET = r"(?<![A-Za-z0-9_])(?=[0-9_]*+[A-Za-z])(?=(?:[A-Za-z_]*+[0-9]){4})[A-Za-z0-9_]{20,}+"
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def located(text: Column, pattern: str) -> Column:
    """Non-overlapping matches from the left: array of (start, end, value); code points, end exclusive."""

    def from_values(values: Column) -> Column:
        def from_gaps(gaps: Column) -> Column:
            steps = F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: F.struct(v.alias("v"), F.length(g).cast("long").alias("g")))
            before = running_sums(F.transform(steps, lambda s: s["g"] + F.length(s["v"])))
            return F.zip_with(
                steps, before, lambda s, b: F.struct((b + s["g"]).alias("start"), (b + s["g"] + F.length(s["v"])).alias("end"), s["v"].alias("value"))
            )

        return F.when(F.size(values) > 0, let(F.split(text, pattern, -1), from_gaps)).otherwise(F.array().cast(_MATCHES))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), from_values)


_MATCHES = "array<struct<start:bigint,end:bigint,value:string>>"
_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _luhn(digits: Column) -> Column:
    def digit(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + digit(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.concat(F.lit("0"), F.regexp_replace(p, "^0+", ""))
        return F.forall(F.split(value, r"\."), lambda p: F.when(F.length(part(p)) <= 4, part(p).cast("int") <= 255).otherwise(False))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


def base_matches(text: Column, kind: str) -> Column:
    """The valid matches of one kind."""
    needs = F.contains(text, F.lit(_NEEDS[kind])) if _NEEDS[kind] else F.rlike(text, F.lit("[0-9].{0,3}[0-9]"))
    found = F.filter(located(text, _PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    return F.when(needs, found).otherwise(F.array().cast(_MATCHES))


def with_matches(docs: DataFrame) -> DataFrame:
    """``docs`` with ``matches__``: kind, start, end and value of all base matches, in order of kind and start."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def named(kind: str) -> Column:
        return F.transform(base_matches(text, kind), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))

    each = [named(kind) for kind in KINDS]
    return docs.withColumn("matches__", F.when(F.rlike(text, F.lit("[0-9@]")), F.concat(*each)).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")))


def _terms(text: Column) -> Column:
    """A text's distinct terms."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower))


def _maybe_broadcast(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``d__`` and ``h__``, by which rows of one doc_id and text are one; neither is null."""
    return docs.withColumn("d__", F.coalesce(F.col("doc_id"), F.lit(0))).withColumn("h__", F.xxhash64("text", F.col("doc_id").isNull()))


def _secrets(text: Column, base: Column) -> Column:
    """Secrets outside of base matches, as those are."""
    found = F.when(F.rlike(text, F.lit("[A-Za-z0-9_]{20}")), located(text, _SECRET)).otherwise(F.array().cast(_MATCHES))
    apart = F.filter(found, lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return F.transform(apart, lambda m: F.struct(F.lit("secret").alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))


def with_values(docs: DataFrame) -> DataFrame:
    """``with_matches`` and ``secrets__``, alike."""
    return with_matches(docs).withColumn("secrets__", _secrets(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("matches__")))


def entity_documents(valued: DataFrame) -> DataFrame:
    """The documents with protected values, once each: d__, h__, values (hashes), kinds, terms."""

    def value(m: Column) -> Column:
        kept = F.when(m["kind"] == "email", F.lower(m["value"])).when(m["kind"].isin("card", "phone"), F.regexp_replace(m["value"], "[^0-9]", "")).otherwise(m["value"])
        return F.xxhash64(m["kind"], kept)

    every = F.concat("matches__", "secrets__")
    rows = _keyed(valued.where("size(matches__) + size(secrets__) > 0"))
    found = rows.select("d__", "h__", F.array_distinct(F.transform(every, value)).alias("values"), F.array_distinct(F.transform(every, lambda m: m["kind"])).alias("kinds"), _terms(F.col("text")).alias("terms"))
    return found.dropDuplicates(["d__", "h__"])


def entity_terms(holders: DataFrame) -> DataFrame:
    """(d__, h__, entity, terms) for each entity of each document: the person's that its values are of, and the kinds.

    A person's values are those that documents connect. A person in fewer documents than
    a term needs has no terms, and no row here.
    """
    kinds = holders.select("d__", "h__", F.explode("kinds").alias("entity"), "terms")
    values = holders.select("d__", "h__", F.explode("values").alias("value"), F.get("values", F.lit(0)).alias("first"))
    persons = connected_components(values.select("first", "value"), "first", "value", native=True)
    of = cut_lineage(values.join(persons, F.col("value") == F.col("node")).select("d__", "h__", F.concat(F.lit("#"), F.col("component").cast("string")).alias("entity")).distinct())
    often = of.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("entity")
    return kinds.union(of.join(often, "entity").join(holders, ["d__", "h__"]).select("d__", "h__", "entity", "terms"))


def disclosing_terms(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(entity, term, disclosure) of the terms that disclose an entity of ``held``, by counts over all of ``docs``."""
    total = F.lit(float(max(1, docs.count())))
    entities = held.groupBy("entity").agg(F.count("*").alias("n_e"))
    # one row for each text of a term first: copies are one text
    texts = held.select("entity", "h__", F.explode("terms").alias("term")).groupBy("entity", "term", "h__").agg(F.count("*").alias("n"))
    pairs = texts.groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT).select("entity", "term", "n_et")
    possible = pairs.join(_maybe_broadcast(entities), "entity")
    share = F.when(F.col("entity").startswith("#"), OF_PERSON).otherwise(OF_KIND)
    possible = cut_lineage(possible.where(F.col("n_et") >= share * F.col("n_e")))
    words = docs.select(F.explode(_terms(F.col("text"))).alias("term")).join(_maybe_broadcast(cut_lineage(possible.select("term").distinct())), "term", "left_semi")
    known = possible.join(words.groupBy("term").agg(F.count("*").alias("n_t")), "term")
    gained = F.log2(F.col("n_et") * total / (F.col("n_e") * F.col("n_t")))
    information = F.log2(total / F.col("n_e"))
    measured = known.withColumn("disclosure", F.when(information > 0, gained / information).otherwise(0.0)).where(F.col("disclosure") >= GENERALISE)
    return measured.select("entity", "term", "disclosure")


def personal_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any others) with ``base``, ``secrets`` and ``terms``, what to hide in each text.

    base and secrets: kind, start, end, in order of kind and start. terms: action (remove
    or generalise), start, end, in order of start, without those inside other spans:
    every place of each term that discloses one of the text's entities, or is to be
    removed for a person's sake anywhere. A null text is an empty one. Rows that repeat a
    doc_id and text get the same spans, a null doc_id is an id like any other, and other
    columns stay; ones named base, secrets or terms are replaced. Very long texts are
    searched whole in linear time. No rows give no rows.
    """
    docs = docs.drop("base", "secrets", "terms")
    valued = with_values(docs)
    holders = cut_lineage(entity_documents(with_values(docs.select("doc_id", "text"))))
    held = cut_lineage(entity_terms(holders))
    action = F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise").alias("action")
    flagged = cut_lineage(disclosing_terms(docs, held).select("entity", "term", action))
    own = held.select("d__", "h__", "entity", F.explode("terms").alias("term")).join(_maybe_broadcast(flagged), ["entity", "term"]).select("d__", "h__", "term", "action")
    anywhere = cut_lineage(flagged.where("entity like '#%' and action = 'remove'").select("term").distinct())
    if anywhere.limit(1).count():
        others = _keyed(docs.select("doc_id", "text")).select("d__", "h__", F.explode(_terms(F.col("text"))).alias("term"))
        own = own.union(others.join(_maybe_broadcast(anywhere), "term").select("d__", "h__", "term", F.lit("remove")))
    which = lambda x: F.collect_set(F.when(F.col("action") == x, F.col("term")))
    told = cut_lineage(own.groupBy("d__", "h__").agg(which("remove").alias("removed__"), which("generalise").alias("generalised__")))
    release(holders, held, flagged, anywhere)
    base = F.transform("matches__", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    secrets = F.transform("secrets__", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    # documents with terms are few next to the texts, which then stay where they are; else both are shuffled. Each is as long as its terms are many
    listed = told.agg(F.coalesce(F.sum(F.size("removed__") + F.size("generalised__")), F.lit(0)).alias("n")).head()["n"]
    beside = F.broadcast(told) if listed <= BROADCAST_ROWS else told
    joined = _keyed(valued.withColumn("base", base).withColumn("secrets", secrets).drop("matches__", "secrets__")).join(beside, ["d__", "h__"], "left")

    def judged(m: Column) -> Column:
        term = F.lower(m["value"])
        says = F.when(F.array_contains("removed__", term), "remove").when(F.array_contains("generalised__", term), "generalise")
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), says.alias("action"))

    hits = F.filter(F.transform(located(F.col("text"), _TERM), judged), lambda t: t["action"].isNotNull())
    joined = joined.withColumn("terms__", F.when(F.col("removed__").isNotNull(), hits))
    apart = F.filter("terms__", lambda t: ~F.exists(F.concat("base", "secrets"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    terms = F.coalesce(F.transform(apart, lambda t: F.struct(t["action"].alias("action"), t["start"].alias("start"), t["end"].alias("end"))), F.array().cast("array<struct<action:string,start:bigint,end:bigint>>"))
    return joined.withColumn("terms", terms).drop("terms__", "d__", "h__", "removed__", "generalised__")


def sanitised(found: DataFrame) -> DataFrame:
    """``personal_spans``' rows with the spans hidden in ``text``: base ones as [EMAIL] and so on, secrets as [SECRET], terms as [TERM] or nothing.

    Where spans overlap, the one that starts first (then the longer, then by name) holds.
    """
    labelled = F.concat(
        F.transform(F.concat("base", "secrets"), lambda b: F.struct(b["start"].alias("start"), (-b["end"]).alias("back"), F.concat(F.lit("["), F.upper(b["kind"]), F.lit("]")).alias("label"))),
        F.transform("terms", lambda t: F.struct(t["start"].alias("start"), (-t["end"]).alias("back"), F.when(t["action"] == "remove", "").otherwise("[TERM]").alias("label"))),
    )
    empty = F.struct(F.lit(0).cast("long").alias("upto"), F.array().cast("array<struct<start:bigint,back:bigint,label:string>>").alias("kept"))
    apart = F.aggregate(
        F.array_sort(labelled),
        empty,
        lambda a, s: F.when(s["start"] >= a["upto"], F.struct((-s["back"]).alias("upto"), F.concat(a["kept"], F.array(s)).alias("kept"))).otherwise(a),
        lambda a: a["kept"],
    )

    def put_together(kept: Column) -> Column:
        ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(kept, lambda s: -s["back"]))
        pieces = F.transform(kept, lambda s, i: F.concat(F.substring(F.col("text"), F.get(ends, i).cast("int") + 1, (s["start"] - F.get(ends, i)).cast("int")), s["label"]))
        rest = F.substring(F.col("text"), F.element_at(ends, -1).cast("int") + 1, F.length("text"))
        return F.concat(F.array_join(pieces, ""), rest)

    hidden = F.size("base") + F.size("secrets") + F.size("terms") > 0
    return found.withColumn("text", F.when(hidden, let(apart, put_together)).otherwise(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' personal data, secrets and disclosing terms."""
    found = personal_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    shown = lambda spans, kind: F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string")))
    base = shown(F.col("base"), lambda s: s["kind"])
    secrets = shown(F.col("secrets"), lambda s: s["kind"])
    terms = shown(F.col("terms"), lambda s: F.lit("term"))
    counted = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [counted(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, secrets, terms), ",").alias("spans"), F.size("secrets").cast("long").alias("n_secret"), F.size("terms").cast("long").alias("n_term"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data, secrets and disclosing terms hidden in their texts; ``n_chars`` follows, if there is one.

    As ``personal_spans`` for nulls, ties, repeated rows and no rows; columns stay, whatever their names.
    """
    out = sanitised(personal_spans(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row__"))))
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(new.get(c, F.col("row__").getField(c)).alias(c) for c in docs.columns))
