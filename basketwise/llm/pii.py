"""Personal data: base patterns, and terms that corpus co-occurrence shows to reveal them.

DataFrame functions only. Spans are code points, the end exclusive.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

#: The patterns of the four base kinds, in order. Runs are possessive and begin where a run of
#: the same characters begins or the last match ended: the same matches, without trying every start again.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone", "word", "number", "code", "removed")
REMOVED = len(KINDS) - 1
#: What stands in place of each kind: a term is generalised to what sort of term it is.
TAGS = ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>", "<WORD>", "<NUMBER>", "<CODE>", "")
TERM = r"[\p{L}\p{N}]++"
CHUNK, BLOCK = 4096, 512


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(f"^{PART}(?:\\.{PART}){{3}}$")
    digits = F.regexp_replace(x, "[^0-9]", "")
    if kind == "card":
        return F.length(x).between(13, 37) & F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def with_matches(df: DataFrame, name: str, text: Column, pattern: str, keep, may: Column | None = None) -> DataFrame:
    """``df`` with all matches for which ``keep(value)`` holds, in order: an array of (start, end, value). The lengths of
    matches and of what stands between them give their places. They are summed in blocks, so that the work
    is in proportion to a text's matches, not to their square. ``may`` says which texts can have any.

    Steps are columns of their own, each read twice: Spark doesn't move such into the functions that read them.
    """
    values, pairs, blocks = f"__{name}_v", f"__{name}_p", f"__{name}_b"
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn(values, every if may is None else F.when(may, every))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(values)), F.length)
    df = df.withColumn(pairs, F.when(F.size(values) > 0, F.arrays_zip(gaps.alias("gap"), F.col(values).alias("value"))))
    df = df.withColumn(blocks, F.when(F.size(pairs) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda i: F.slice(pairs, i * BLOCK + 1, BLOCK))))
    width = lambda x: x["gap"] + F.length(x["value"])
    widths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda at, x: at + width(x)))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    begins = F.aggregate(widths, F.struct(F.lit(0).alias("at"), none("int").alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["value"])
        more = F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))))
        return F.struct(end.alias("at"), F.when(keep(x["value"]), more).otherwise(acc["out"]).alias("out"))

    kind = "struct<start:int,end:int,value:string>"
    one = lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none(kind).alias("out")), step, lambda acc: acc["out"])
    return df.withColumn(name, F.coalesce(F.flatten(F.zip_with(blocks, begins, one)), none(kind))).drop(values, pairs, blocks)


def base_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``__base``: an array of (kind, start, end, value), kind counted from 0, in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": text.rlike(r"\+[0-9]")}
    for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE)):
        df = with_matches(df, f"__{kind}", text, pattern, partial(_valid, kind), may[kind])

    def of_kind(i: int) -> Column:
        return F.transform(f"__{KINDS[i]}", lambda x: F.struct(F.lit(i).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    return df.withColumn("__base", F.concat(*map(of_kind, range(4)))).drop(*(f"__{kind}" for kind in KINDS[:4]))


def chunks_of(text: Column) -> Column:
    """A text in pieces of ``CHUNK`` code points, where any place can be reached without counting from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(chunks: str, low: Column, high: Column) -> Column:
    """The text from ``low`` to ``high``, ``CHUNK`` code points at most."""
    i = F.floor(low / CHUNK).cast("int")
    two = F.concat(F.coalesce(F.get(chunks, i), F.lit("")), F.coalesce(F.get(chunks, i + 1), F.lit("")))
    return two.substr(low - i * CHUNK + 1, high - low)


def contexts(chunks: str, spans: str, reach: int) -> Column:
    """For each span the ``reach`` code points on either side: (entity, snippet)."""

    def sides(s):
        low = F.greatest(s["start"] - reach, F.lit(0))
        entity = F.concat_ws(":", s["kind"].cast("string"), F.when(s["kind"] == 0, F.lower(s["value"])).otherwise(F.regexp_replace(s["value"], r"[^0-9.]", "")))
        return F.array(*(F.struct(entity.alias("entity"), cut(chunks, a, b).alias("snippet")) for a, b in ((low, s["start"]), (s["end"], s["end"] + reach))))

    return F.flatten(F.transform(spans, sides))


def overlaid(chunks: str, spans: str, mark) -> Column:
    """The text with each span, or spans that overlap, replaced by ``mark(the first one)``, chunk by chunk. ``spans``
    is in order of where they start."""

    def one(chunk, i):
        low = i * CHUNK

        def step(acc, s):
            free = s["start"] >= acc["at"]
            piece = F.concat(chunk.substr(acc["at"] - low + 1, s["start"] - acc["at"]), mark(s))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(free, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

        here = F.filter(spans, lambda s: (s["start"] < low + CHUNK) & (s["end"] > low))
        rest = lambda acc: F.concat(acc["out"], chunk.substr(acc["at"] - low + 1, F.lit(CHUNK)))
        return F.aggregate(here, F.struct(low.alias("at"), F.lit("").alias("out")), step, rest)

    return F.when(F.size(spans) > 0, F.array_join(F.transform(chunks, one), "")).otherwise(F.array_join(chunks, ""))


def masked(chunks: str, spans: str) -> Column:
    """The text with what spans cover as line feeds, so that places stay. ``spans`` is in order of where they start."""

    def one(chunk, i):
        low = i * CHUNK

        def step(acc, s):
            begin = F.greatest(acc["at"], s["start"])
            stop = F.greatest(begin, F.least(s["end"], low + CHUNK))
            piece = F.concat(chunk.substr(acc["at"] - low + 1, begin - acc["at"]), F.repeat(F.lit("\n"), stop - begin))
            return F.struct(stop.alias("at"), F.when(s["end"] > acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

        here = F.filter(spans, lambda s: (s["start"] < low + CHUNK) & (s["end"] > low))
        rest = lambda acc: F.concat(acc["out"], chunk.substr(acc["at"] - low + 1, F.lit(CHUNK)))
        return F.aggregate(here, F.struct(low.alias("at"), F.lit("").alias("out")), step, rest)

    return F.array_join(F.transform(chunks, one), "")


def terms_of(text: Column) -> Column:
    """The distinct terms of a text in lower case. Two letters depend on what stands beside them, or become what is
    no term: texts with these are lowered term by term, as ``with_matches`` does, all others at once."""
    every = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(TERM), F.lit(0)))
    return F.when(text.rlike("[\u0130\u03a3]"), F.array_distinct(F.transform(every(text), F.lower))).otherwise(every(F.lower(text)))


def marked(docs: DataFrame, reach: int, id_col: str, text_col: str) -> DataFrame:
    """``(k, id, base, near, chunks)`` of each row, written once: the base spans, and where there are any, each entity
    with a hash of what stands around it and the text."""
    rows = docs.select(F.xxhash64(id_col, text_col).alias("k"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = base_spans(rows).withColumnRenamed("__base", "base")
    rows = rows.withColumn("chunks", F.when(F.size("base") > 0, chunks_of(F.col("text"))))
    near = F.transform(contexts("chunks", "base", reach), lambda n: F.struct(n["entity"].alias("entity"), F.xxhash64(n["snippet"]).alias("context")))
    rows = rows.withColumn("near", F.when(F.size("base") > 0, near))
    slim = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return written(rows.select("k", "id", slim.alias("base"), "near", "chunks"), "base")


def entities(held: DataFrame, support: int) -> DataFrame:
    """``(k, id, entity, context, n_entity)`` for entities of ``support`` documents at least, equal entities once: of those that
    stand in the same documents, in the same ones of them in equal contexts, one stands for all, as all meet the same
    terms. The context is the least document with all the same around the entity."""
    one = held.select("k", "id", F.explode("near").alias("n")).groupBy("k", "id", "n.entity").agg(F.xxhash64(F.sort_array(F.collect_set("n.context"))).alias("around"))
    one = written(one, "entities")
    first = one.groupBy("entity", "around").agg(F.min(F.struct("k", "id")).alias("first"))
    placed = one.join(first, ["entity", "around"]).select("k", "id", "entity", F.xxhash64("first.k", "first.id").alias("context"))
    placed = written(placed, "contexts")
    signs = (F.bit_xor(F.xxhash64(F.lit(seed), "k", "id", "context")).alias(f"sign{seed}") for seed in (1, 2))
    sets = placed.groupBy("entity").agg(F.count("*").alias("n_entity"), *signs).where(F.col("n_entity") >= support)
    chosen = written(sets.groupBy("sign1", "sign2", "n_entity").agg(F.min("entity").alias("entity")).select("entity", "n_entity"), "often")
    return written(placed.join(chosen, "entity"), "entities")


def plain_texts(base: DataFrame) -> DataFrame:
    """``(k, id, text)`` of documents with base spans, which are line feeds there, equal rows once. Written, so that what is made of
    a text is made once: a filter that Spark derives from an explode would hold all steps that lead to it."""
    held = base.where("chunks is not null").dropDuplicates(["k", "id"])
    ordered = F.sort_array(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    held = written(held.select("k", "id", "chunks", ordered.alias("ordered")), "ordered")
    return written(held.select("k", "id", masked("chunks", "ordered").alias("text")), "plain")


def term_sets(plain: DataFrame, of: DataFrame, support: int) -> tuple[DataFrame, DataFrame]:
    """``(k, id, t)`` and ``(t, term, n_near)``: the terms outside base spans of the documents ``of`` that stand in ``support`` of
    them at least, those of the same documents as one ``t``."""
    there = of.select(F.col("k").alias("of_k"), F.col("id").alias("of_id")).distinct()
    near = plain.join(there, (F.col("k") == F.col("of_k")) & F.col("id").eqNullSafe(F.col("of_id")), "left_semi")
    near = written(near.select("k", "id", F.explode(terms_of(F.col("text"))).alias("term")), "near")
    signs = (F.bit_xor(F.xxhash64(F.lit(seed), "k", "id")).alias(f"sign{seed}") for seed in (1, 2))
    sets = near.groupBy("term").agg(F.count("*").alias("n_near"), *signs).where(F.col("n_near") >= support)
    sets = written(sets, "sets")
    named = sets.groupBy("sign1", "sign2", "n_near").agg(F.min("term").alias("t"))
    members = written(sets.join(named, ["sign1", "sign2", "n_near"]).select("t", "term", "n_near"), "members")
    chosen = members.where("t = term").select("term")
    return near.join(chosen, "term").select("k", "id", F.col("term").alias("t")), members


def disclosing(docs: DataFrame, base: DataFrame, plain: DataFrame, general: float, remove: float, support: int, text_col: str, broadcast_terms: int) -> DataFrame:
    """``(k, id, term, kind)`` of the terms in each document that reveal an entity there.

    With documents as events (equal rows are one), a term reveals ``PMI(entity; term)`` bits of the ``-log2 P(entity)``
    bits that the entity holds; the ratio is at most 1, where the term names the entity alone. A pair needs ``support``
    documents, and in them as many different contexts of the entity, else every rare word would reveal what
    stands in the same text. How many documents hold a term is counted over the whole corpus, for terms of supported
    pairs; those are broadcast only if they are at most ``broadcast_terms``, else joined by a shuffle.

    Entities that stand in the same documents, and terms that do, meet as one each, and only such as have ``support``: a list
    that many documents hold is one entity and one term, however long.
    """
    of = entities(base.where("chunks is not null").dropDuplicates(["k", "id"]), support)
    terms, members = term_sets(plain, of, support)
    both = of.join(terms.withColumnsRenamed({"k": "t_k", "id": "t_id"}), (F.col("k") == F.col("t_k")) & F.col("id").eqNullSafe(F.col("t_id"))).select("k", "id", "entity", "context", "n_entity", "t")
    copies = written(base.groupBy("k", "id").agg(F.count("*").alias("times")), "copies")
    total = float(copies.count())
    repeated = written(copies.where("times > 1").select(F.col("k").alias("r_k"), F.col("id").alias("r_id"), "times"), "repeated")
    n_repeated = repeated.count()
    bits = F.log2(F.lit(total) / F.col("n_entity"))
    share = lambda n: F.log2(F.col("n_both") * F.lit(total) / (F.col("n_entity") * n)) / bits
    seen = both.groupBy("entity", "n_entity", "t", "context").agg(F.count("*").alias("n")).groupBy("entity", "n_entity", "t").agg(F.sum("n").alias("n_both"), F.count("*").alias("contexts"))
    seen = seen.where((F.col("contexts") >= support) & (F.col("n_both") >= support) & (bits > 0))
    # a term is in at least the documents that hold it and any entity: pairs that this rules out go now
    pairs = written(seen.join(members.where("t = term").select("t", "n_near"), "t").where(share(F.col("n_near")) >= general), "pairs")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.xxhash64(*docs.columns[:1], text_col).alias("k"), F.col(docs.columns[0]).alias("id"), text.alias("__text"))

    if n_repeated:
        same = (F.col("k") == F.col("r_k")) & F.col("id").eqNullSafe(F.col("r_id"))
        keyed = keyed.join(F.broadcast(repeated) if n_repeated <= broadcast_terms else repeated, same, "left").select("__text", F.coalesce("times", F.lit(1)).alias("times"))
    else:
        keyed = keyed.select("__text", F.lit(1).cast("long").alias("times"))

    def holding(some: DataFrame, wanted: DataFrame) -> DataFrame:
        """How many different documents of ``some`` hold each term of ``wanted``. Rows are counted, by how often their document
        stands in the table: as many rows are one document."""
        n = wanted.count()
        hits = some.select("times", F.explode(terms_of(F.col("__text"))).alias("term")).join(F.broadcast(wanted) if n <= broadcast_terms else wanted, "term")
        rows = hits.groupBy("term", "times").agg(F.count("*").alias("rows"))
        return rows.groupBy("term").agg(F.sum(F.expr("rows div times")).alias("n_term"))

    def wanted() -> DataFrame:
        """``(t, term, n_near)`` of the terms of pairs."""
        return written(members.join(pairs.select("t").distinct(), "t"), "terms")

    # first the documents that may hold base spans, a few of all: their count is a bound that rules out most terms
    few = keyed.where(F.col("__text").contains("@") | F.col("__text").rlike(r"[0-9][\x20.-]?[0-9]"))
    own = wanted()
    low = written(own.join(holding(few, own.select("term")), "term"), "low")
    bound = low.groupBy("t").agg(F.min("n_term").alias("n_term"))
    pairs = written(pairs.join(bound, "t").where(share(F.greatest("n_term", "n_near")) >= general).drop("n_term"), "pairs")
    own = wanted()
    told = base.select("k", "id", F.lit("").alias("term"), F.lit(4).alias("kind"))
    if own.isEmpty():
        return told.limit(0)
    own = written(own.join(holding(keyed, own.select("term")), "term"), "terms")
    # terms of one t that as many documents hold have the same shares
    n_of = F.greatest("n_term", "n_both")
    shares = pairs.join(own.select("t", "n_term").distinct(), "t").where(share(n_of) >= general).select("entity", "t", "n_term", (share(n_of) >= remove).cast("int").alias("level"))
    # of pairs of one t and count only those that stand together in a document are looked at
    there = both.join(shares, ["entity", "t"]).groupBy("k", "id", "t", "n_term").agg(F.max("level").alias("level"))
    told = there.join(own.select("t", "n_term", "term"), ["t", "n_term"])
    return told.select("k", "id", "term", F.when(F.col("level") == 1, REMOVED).when(~F.col("term").rlike(r"\p{N}"), 4).when(~F.col("term").rlike(r"\p{L}"), 5).otherwise(6).alias("kind"))


def sanitised_spans(docs: DataFrame, reach: int = 48, general: float = 0.7, remove: float = 0.9, support: int = 2, id_col: str = "doc_id", text_col: str = "text", broadcast_terms: int = 200_000) -> DataFrame:
    """``(k, id, base, added)`` of each row: arrays of (kind, start, end) with kinds counted in ``KINDS``.

    Base spans come from the patterns. Terms of documents that hold an entity whose share of its information,
    by co-occurrence over all documents, reaches ``general`` are to be generalised, from ``remove`` on to be
    removed, wherever they stand outside base spans in documents that hold the entity. ``reach`` code points on either side
    are an entity's context. A share equal to a threshold reaches it. Null text counts as empty; rows that repeat an id with
    another text stay apart; equal rows count once and get equal spans; an empty table gives no rows. Places in a text of
    any length are summed in blocks, and pieces are taken from chunks; its terms and entities meet by joins, those of the same
    documents as one, so what a document costs beyond its text are its different kinds of entities times those of terms.
    """
    base = marked(docs, reach, id_col, text_col)
    plain = plain_texts(base)
    told = written(disclosing(docs.select(id_col, text_col), base, plain, general, remove, support, text_col, broadcast_terms), "told")
    of = told.select(F.col("k").alias("t_k"), F.col("id").alias("t_id")).distinct()
    held = plain.join(of, (F.col("k") == F.col("t_k")) & F.col("id").eqNullSafe(F.col("t_id")), "left_semi")
    hits = written(with_matches(held, "__terms", F.col("text"), TERM, lambda x: F.lit(True)).select("k", "id", "__terms"), "mentions").select("k", "id", F.explode("__terms").alias("x"))
    hits = hits.select(F.col("k").alias("h_k"), F.col("id").alias("h_id"), F.lower("x.value").alias("h_term"), "x.start", "x.end")
    hits = hits.join(told, (F.col("h_term") == F.col("term")) & (F.col("h_k") == F.col("k")) & F.col("h_id").eqNullSafe(F.col("id")))
    added = hits.groupBy(F.col("k").alias("of_k"), F.col("id").alias("of_id")).agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    joined = base.join(added, (F.col("k") == F.col("of_k")) & F.col("id").eqNullSafe(F.col("of_id")), "left")
    return joined.select("k", "id", "base", F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>")).alias("added"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, as ``sanitised_spans``
    finds them; ``spans`` lists base spans and added ones as ``kind:start:end``."""
    df = sanitised_spans(docs, id_col=id_col, text_col=text_col, **options)
    names = F.array(*(F.lit(k) for k in KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    every = F.concat("base", "added")
    return df.select(F.col("id").alias(id_col), *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(every).alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` with each span's text replaced by its kind's tag (removed terms by nothing) and, if there, the
    column ``size_col`` set to the new number of characters. Where spans overlap, what they cover together gets the tag
    of the first. Texts without spans, null ones too, stay as they are."""
    spans = sanitised_spans(docs, id_col=id_col, text_col=text_col, **options).where(F.size("base") > 0)
    spans = spans.groupBy(F.col("k").alias("__k")).agg(F.first(F.concat("base", "added")).alias("__spans"))
    df = docs.withColumn("__key", F.xxhash64(id_col, text_col)).join(spans, F.col("__key") == F.col("__k"), "left")
    ordered = F.sort_array(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    df = df.withColumns({"__ordered": ordered, "__chunks": F.when(F.col("__spans").isNotNull(), chunks_of(F.col(text_col)))})
    new = overlaid("__chunks", "__ordered", lambda s: F.get(F.array(*map(F.lit, TAGS)), s["kind"]))
    df = df.withColumn("__new", F.when(F.col("__spans").isNotNull(), new).otherwise(F.col(text_col)))
    out = []
    for c, kind in docs.dtypes:
        if c == text_col:
            out.append(F.col("__new").alias(c))
        elif c == size_col:
            out.append(F.when(F.col("__spans").isNotNull(), F.length("__new").cast(kind)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
