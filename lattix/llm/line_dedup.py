"""Removal of repeated lines, exact or within one edit, by a deletion-neighbourhood join. DataFrame functions only.

Two lines are within one edit if they are equal, differ in one character, or one has one
character more. Leaving out the right character makes such lines equal, so lines meet in
the hashed variants they emit. Only what can still differ emits them: a line cut into pieces
must agree with a neighbour on all pieces but one, so lines are first joined on all but
one of 2 pieces, those that met on all but one of 16, and only the piece left open between
lines that met there has its characters left out, one by one. Equal lines are one line from
the start: it carries the hashes of its halves, so its text is read again only if it meets another.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.llm.scratch import drop_since, made, numbered, written

#: Of lines of so many characters or more one edit is at most a fifth, so they are similar by 0.8; shorter ones repeat only what they equal.
MIN_CHARS = 5
WORD = r"[^\x20\x09-\x0D]"
PIECES = (2, 16)
#: Columns with what a line agrees on with others at the first of PIECES.
SIGS = [f"sig{k}" for k in range(2 * PIECES[0])]
#: A place is doc_id * TEXTS + number of the text * LINES + line number; texts without an id come after all others.
TEXTS, LINES = 10**19, 10**10
LAST = 93 * 10**36
#: Up to so many lines are sent to every executor to fetch their text; beyond, they are joined by a shuffle.
BROADCAST_LINES = 500_000


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_LINES else rows


def _texts(rows: DataFrame) -> DataFrame | None:
    """(doc_id, version, text_no) of texts that don't have their id to themselves, or have none; None if there aren't any. rows has one for each id and text."""
    shared = written(rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("own")), "shared")
    shared = written(rows.join(_small(shared), F.col("doc_id").eqNullSafe(F.col("own")), "left_semi").select("doc_id", "version"), "shared")
    if shared.isEmpty():
        return None
    lines, _ = numbered(shared.repartitionByRange("doc_id", "version").sortWithinPartitions("doc_id", "version"), "texts")
    first = lines.groupBy(F.col("doc_id").alias("own")).agg(F.min("number").alias("first"))
    return lines.join(first, F.col("doc_id").eqNullSafe(F.col("own"))).select("doc_id", "version", (F.col("number") - F.col("first")).alias("text_no"))


def _lines(documents: DataFrame, min_chars: int, texts: DataFrame | None) -> DataFrame:
    """(doc_id, version, line_no, line, h1, h2, place) of the lines that count."""
    whole = lambda c: c.cast("decimal(38,0)")
    start = F.col("doc_id").cast("decimal(19,0)") * F.lit(Decimal(TEXTS))
    if texts is None:
        documents = documents.withColumn("start", whole(start))
    else:
        texts = _small(texts.withColumnsRenamed({"doc_id": "own", "version": "own_version"}))
        number = F.coalesce("text_no", F.lit(0)).cast("decimal(19,0)") * F.lit(Decimal(LINES))
        joined = documents.join(texts, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("version") == F.col("own_version")), "left")
        documents = joined.withColumn("start", whole(whole(F.coalesce(start, F.lit(Decimal(LAST)))) + whole(number)))
    split = F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    lines = documents.select("doc_id", "version", "start", split).where((F.length("line") >= min_chars) | F.col("line").rlike(WORD))
    return lines.select("doc_id", "version", "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), whole(F.col("start") + F.col("line_no")).alias("place"))


def _agreements(pieces: int, chars: str = "chars") -> list[tuple[str, str, int]]:
    """(sig, m, piece) of a line of chars characters: a hash of all but one piece, as the longer and as the shorter of two lines.

    m is the length of the shorter line of a pair. The pieces of m are cut at j * m / pieces; what precedes the
    piece is taken from the left end and what follows it from the right end, so that the piece may be one longer.
    """

    def sig(m: str, j: int) -> str:
        before, after = f"{j} * {m} div {pieces}", f"({m} - ({j} + 1) * {m} div {pieces})"
        ends = [f"substring(line, 1, {before})"] * (j > 0) + [f"substring(line, int({chars} + 1 - {after}), {chars})"] * (j < pieces - 1)
        return f"xxhash64({', '.join([m, str(j), *ends])})"

    return [(sig(m, j), m, j) for m in (chars, f"({chars} - 1)") for j in range(pieces)]


def _met(rows: DataFrame) -> DataFrame:
    """Those of rows whose sig another row has too. rows has h1, h2, sig of distinct lines."""
    more = rows.groupBy("sig").count().where("count > 1").select("sig")
    return rows.join(more, "sig", "left_semi")


def _near(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Distinct lines that have an earlier line within one edit: h1, h2. found has (h1, h2, place, *SIGS) of every distinct line; SIGS are null for those too short."""
    keys = written(_met(found.select("h1", "h2", F.explode(F.array(*SIGS)).alias("sig")).where("sig is not null")).select("h1", "h2").distinct(), "met")
    keys = written(found.join(_small(keys), ["h1", "h2"], "left_semi").select("h1", "h2", F.col("place").alias("first")), "met_places")
    lines = lines.join(_small(keys), ["h1", "h2"]).where("place = first")
    first = written(lines.select("h1", "h2", "line", F.length("line").alias("chars"), "place"), "met_lines")
    agreements = ", ".join(f"struct({sig} as sig, int({m}) as m, {j} as piece)" for sig, m, j in _agreements(PIECES[-1]))
    rows = first.select("h1", "h2", F.explode(F.expr(f"array({agreements})")).alias("x")).select("h1", "h2", "x.*")
    open_ = _met(rows).join(first, ["h1", "h2"])
    cut = f"int(piece * m div {PIECES[-1]})"
    size = f"int(chars - (m - (piece + 1) * m div {PIECES[-1]}) - {cut})"
    left_out = "transform(sequence(1, length(middle)), p -> struct({0} as role, {1} as at, concat(substring(middle, 1, p - 1), substring(middle, p + 1)) as rest))"
    same = "array_append(" + left_out.format("'same'", "p") + ", struct('short' as role, 0 as at, middle as rest))"
    longer = "array_distinct(" + left_out.format("'long'", "0") + ")"
    variants = (
        open_.withColumn("middle", F.expr(f"substring(line, {cut} + 1, {size})"))
        .select("place", "sig", F.explode(F.expr(f"if(length(middle) = 0, array(struct('short' as role, 0 as at, middle as rest)), if(m = chars, {same}, {longer}))")).alias("v"))
        .select("place", F.col("v.role").alias("role"), F.xxhash64("sig", "v.at", "v.rest").alias("variant"))
    )
    variants = written(variants.distinct(), "variants")
    least = lambda role: F.min(F.when(F.col("role") == role, F.col("place"))).alias(role)
    groups = variants.groupBy("variant").agg(least("same"), least("short"), least("long"), F.count("*").alias("n")).where("n > 1")
    witness = F.when(F.col("role") == "same", F.col("same")).when(F.col("role") == "short", F.col("long")).otherwise(F.col("short"))
    pairs = variants.join(groups, "variant").select("place", witness.alias("witness")).where("witness < place").distinct()
    a = first.select("place", "h1", "h2", "line")
    b = first.select(F.col("place").alias("witness"), F.col("line").alias("earlier"))
    return pairs.join(a, "place").join(b, "witness").where(F.levenshtein("line", "earlier", 1).between(0, 1)).select("h1", "h2").distinct()


def repeated_lines(documents: DataFrame, min_chars: int = MIN_CHARS, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, version, line_no) of every line to go. documents has (doc_id, version, text), version being a hash of the text, texts what _texts() gives."""
    lines = _lines(documents, min_chars, texts)
    sigs = [F.when(F.length("line") >= min_chars, F.expr(sig)).alias(name) for name, (sig, _, _) in zip(SIGS, _agreements(PIECES[0], "length(line)"), strict=True)]
    hashed = lines.select("h1", "h2", "place", *sigs)  # equal lines have equal sigs, so any of them will do
    found = written(hashed.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count("*").alias("n"), *[F.min(x).alias(x) for x in SIGS]), "lines")
    near = written(_near(found, lines.where(F.length("line") >= min_chars)), "near").withColumn("near", F.lit(True))
    fate = found.join(near, ["h1", "h2"], "left").where("n > 1 or near").select("h1", "h2", F.col("place").alias("first"), "near")
    gone = lines.drop("line").join(fate, ["h1", "h2"]).where(F.coalesce("near", F.lit(False)) | (F.col("place") > F.col("first")))
    return gone.select("doc_id", "version", "line_no")


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines of these numbers."""
    split = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
    return F.get(F.transform(F.array(split), lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")), F.lit(0))


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with text_col less its repeated lines, and n_lines and n_removed, which replace columns of these names; other columns stay.

    A line with a word goes if an earlier line, by document id and line number, of any document is equal to it. A line of min_chars
    characters or more goes also without a word, and if an earlier line of as many is within one edit of it, be that one kept or not. So the earliest of each group
    stays. The bound of one edit is the neighbourhood's and no parameter. Lines end at a line feed. Null text stays null with no lines; an empty text has one empty line.
    Documents with one id come in the order of a hash of their texts, those without an id after all others in the same order. Of rows that repeat id and text
    any one is the first. Ids are numbers.
    """
    text = F.col(f"`{text_col}`").cast("string")
    names = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    keyed = documents.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{id_col}`").cast("long").alias("__id"), F.xxhash64(text).alias("__version"))
    spark, start = documents.sparkSession, made()
    rows = written(keyed.where(text.isNotNull()).groupBy(F.col("__id").alias("doc_id"), F.col("__version").alias("version")).count(), "rows")
    again, parts, kept = rows.where("count > 1").select("doc_id", "version"), [keyed], []
    if not again.isEmpty():  # one row of each goes on as any other
        few = written(again.select(F.col("doc_id").alias("__few_id"), F.col("version").alias("__few_version")), "again")
        same = F.col("__id").eqNullSafe(F.col("__few_id")) & (F.col("__version") == F.col("__few_version"))
        copies = written(keyed.join(_small(few), same, "left_semi").withColumn("__row", F.monotonically_increasing_id()), "copies")
        first = written(copies.groupBy("__id", "__version").agg(F.min("__row").alias("__row")).select("__row"), "firsts")
        parts = [keyed.join(_small(few), same, "left_anti"), copies.join(_small(first), "__row", "left_semi").drop("__row")]
        kept = [few, copies, first]
    main = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    own = main.select(F.col("__id").alias("doc_id"), F.col("__version").alias("version"), text.alias("text"))
    gone = written(repeated_lines(own, min_chars, _texts(rows)), "gone")
    drop_since(spark, start, gone, *kept)
    gone = gone.groupBy(F.col("doc_id").alias("__of"), F.col("version").alias("__of_version")).agg(F.collect_set("line_no").alias("__gone"))
    out = main.join(gone, F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__version") == F.col("__of_version")), "left").select(*[F.col(f"`{c}`") for c in names], "__gone")
    if kept:  # all lines that count of a row's copies stand earlier
        counts = lambda lines: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (F.length(F.get(lines, i)) >= min_chars) | F.get(lines, i).rlike(WORD))
        every = F.get(F.transform(F.array(F.split(text, "\n")), counts), F.lit(0))
        out = out.unionByName(copies.join(_small(first), "__row", "left_anti").select(*[F.col(f"`{c}`") for c in names], every.alias("__gone")))
    new = F.when(F.coalesce(F.size("__gone"), F.lit(0)) <= 0, F.col(f"`{text_col}`")).otherwise(_without(text, F.col("__gone"))).alias(text_col)
    return out.select(
        *[new if c == text_col else F.col(f"`{c}`") for c in names],
        F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("__gone").isNotNull(), F.size("__gone")), F.lit(0)).cast("long").alias("n_removed"),
    )
