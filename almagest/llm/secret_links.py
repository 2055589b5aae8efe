"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong kinds are reported wherever they are found: `assign` (keyword and value), `access`
(access key ids) and `hex` (long hexadecimal runs). Weak kinds mean little alone: `ident`
(user or client names), `blob` (long mixed runs) and `endpoint` (addresses of services).
Parts have roles: identifiers (access, ident), secrets (assign, hex, blob), endpoints. An
interval join finds, for every weak part, the parts of the same text at most SCOPE code
points away: a weak identifier is reported if a secret is near, a blob if an identifier
is near, an endpoint if both are. A weak part that overlaps a strong one is part of that.

Texts are read once and never shuffled. A text that matches nothing leaves no row; the
others leave one small row per match with the length of the match and of the gap before
it, whose running sums are the positions. The join is by text and scope cell: a part lies
in few cells and a scope holds few parts, as matches of a kind don't overlap.

Defined cases. A null text is an empty one without parts. Repeated rows get equal results;
rows that share an id but differ in text are kept apart by a fingerprint of the text. A
null id is an id of its own. An empty table gives an empty result. Other columns are not
read, so their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from almagest.llm.common import settled, text_or_empty

SCOPE = 200

# fixed patterns of the base kinds
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
# weak kinds
IDENT = r"(client_id|account_id|username|user|login)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[A-Za-z0-9@._-]+"
BLOB = r"[A-Za-z0-9/+]{40,}"
ENDPOINT = r"https?://[A-Za-z0-9.:/_-]+"

#: kind, pattern, role, weak. Runs of the hexadecimal class with 24 or more characters are
#: whole runs either way, so their bound stands in the pattern; values of assign and access
#: are tested after matching.
KINDS = (
    ("assign", ASSIGN, "secret", False),
    ("access", ACCESS, "identifier", False),
    ("hex", HEX, "secret", False),
    ("ident", IDENT, "identifier", True),
    ("blob", BLOB, "secret", True),
    ("endpoint", ENDPOINT, "endpoint", True),
)


def _valid(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.char_length(F.regexp_extract(match, ASSIGN, 2)) >= 6
    if kind == "access":
        return F.char_length(match) >= 20
    if kind == "blob":
        return match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]")
    return F.lit(True)


def _matches(kind: int) -> Column:
    """All matches of one kind in a text, failing ones too: they count for the positions."""
    name, pattern, _, _ = KINDS[kind]
    empty = F.array().cast("array<struct<kind:int,i:int,gap:long,len:long,valid:boolean>>")

    def part(x: Column, i: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            i.cast("int").alias("i"),
            F.char_length(x["gap"]).cast("long").alias("gap"),
            F.char_length(x["match"]).cast("long").alias("len"),
            _valid(name, x["match"]).alias("valid"),
        )

    found = F.regexp_extract_all("__text", F.lit(pattern), 0)
    gaps = F.slice(F.split("__text", pattern, -1), F.lit(1), F.size(found))
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("match"))
    return F.when(F.col("__text").rlike(pattern), F.transform(pairs, part)).otherwise(empty)


def parts(df: DataFrame) -> DataFrame:
    """(doc_id, print, kind, start, end): valid parts of all kinds, weak ones too."""
    rows = df.select("doc_id", text_or_empty().alias("__text"))
    # the text is read once: kinds are arrays of one row, joined and exploded together
    found = rows.select(
        "doc_id", F.xxhash64("__text").alias("print"), F.explode(F.concat(*[_matches(k) for k in range(len(KINDS))])).alias("p")
    )
    found = found.select("doc_id", "print", "p.*").dropDuplicates(["doc_id", "print", "kind", "i"])
    order = Window.partitionBy("doc_id", "print", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("len")).over(order)
    return (
        found.withColumn("end", end)
        .where("valid")
        .select("doc_id", "print", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    )


def _kinds(test) -> list[int]:
    return [k for k, x in enumerate(KINDS) if test(x)]


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts that have their complement within `scope` code points."""
    weak = found.where(F.col("kind").isin(_kinds(lambda x: x[3])))

    def cell(c: Column) -> Column:
        return F.floor(c / scope)

    left = weak.select(
        "doc_id",
        "print",
        "kind",
        "start",
        "end",
        F.explode(F.sequence(cell(F.col("start") - scope), cell(F.col("end") + scope))).alias("cell"),
    )
    # every other part in the cells it covers; the pair counts in the first common cell only,
    # which does not matter here, as the flags below are maxima
    right = found.select(
        F.col("doc_id").alias("o_doc"),
        F.col("print").alias("o_print"),
        F.col("kind").alias("o_kind"),
        F.col("start").alias("o_start"),
        F.col("end").alias("o_end"),
        F.explode(F.sequence(cell(F.col("start")), cell(F.col("end") - 1))).alias("o_cell"),
    )
    near = (
        F.col("doc_id").eqNullSafe(F.col("o_doc"))
        & (F.col("print") == F.col("o_print"))
        & (F.col("cell") == F.col("o_cell"))
        & (F.col("o_start") <= F.col("end") + scope)
        & (F.col("o_end") >= F.col("start") - scope)
    )
    overlap = (F.col("o_start") < F.col("end")) & (F.col("o_end") > F.col("start"))

    def role(r: str) -> Column:
        return F.col("o_kind").isin(_kinds(lambda x: x[2] == r)) & ~overlap

    flags = (
        left.join(right, near)
        .groupBy("doc_id", "print", "kind", "start", "end")
        .agg(
            F.max(role("identifier")).alias("identifier"),
            F.max(role("secret")).alias("secret"),
            F.max(overlap & F.col("o_kind").isin(_kinds(lambda x: not x[3]))).alias("inside"),
        )
    )
    complement = {
        "identifier": F.col("secret"),
        "secret": F.col("identifier"),
        "endpoint": F.col("identifier") & F.col("secret"),
    }
    wanted = F.lit(False)
    for r, test in complement.items():
        wanted = wanted | (F.col("kind").isin(_kinds(lambda x, r=r: x[3] and x[2] == r)) & test)
    return flags.where(~F.col("inside") & wanted).select("doc_id", "print", "kind", "start", "end")


def scan(df: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Reported spans per row of (doc_id, text): counts, base_sha256, and all spans in order."""
    found = settled(parts(df), "secret-parts")
    strong = found.where(F.col("kind").isin(_kinds(lambda x: not x[3])))
    reported = strong.unionByName(linked(found, scope))
    name = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind") + 1)
    label = F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string"))
    span = F.struct("start", "kind", label.alias("label"))
    base = F.col("kind") < 3

    def counted(k: int) -> Column:
        return F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).cast("long")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda x: x["label"]), ",")

    per_text = reported.groupBy(F.col("doc_id").alias("p_doc"), F.col("print").alias("p_print")).agg(
        counted(0).alias("n_assign"),
        counted(1).alias("n_access"),
        counted(2).alias("n_hex"),
        joined(F.collect_list(F.when(base, span))).alias("base"),
        joined(F.collect_list(span)).alias("spans"),
    )
    rows = df.select("doc_id", F.xxhash64(text_or_empty()).alias("print"))
    joined_rows = rows.join(per_text, F.col("doc_id").eqNullSafe(F.col("p_doc")) & (F.col("print") == F.col("p_print")), "left")
    return joined_rows.select(
        "doc_id",
        *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("n_assign", "n_access", "n_hex")],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def _sql_matches(k: int) -> str:
    name, pattern, _, _ = KINDS[k]
    test = {
        "assign": f"length(regexp_extract(m, '{pattern}', 2)) >= 6",
        "access": "length(m) >= 20",
        "blob": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')",
    }.get(name, "true")
    return (
        f"SELECT doc_id, {k} AS kind, '{name}' AS name, e - length(m) AS s, e, {test} AS valid FROM ("
        f"SELECT doc_id, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM ("
        f"SELECT doc_id, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM ("
        f"SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS ms, "
        f"string_split_regex(coalesce(text, ''), '{pattern}') AS gs FROM documents)))"
    )


SQL = f"""
WITH found AS (SELECT * FROM ({" UNION ALL ".join(_sql_matches(k) for k in range(len(KINDS)))}) WHERE valid),
near AS (
  SELECT w.doc_id, w.kind, w.name, w.s, w.e,
    bool_or(o.kind IN (1, 3) AND NOT (o.s < w.e AND o.e > w.s)) AS identifier,
    bool_or(o.kind IN (0, 2, 4) AND NOT (o.s < w.e AND o.e > w.s)) AS secret,
    bool_or(o.kind < 3 AND o.s < w.e AND o.e > w.s) AS inside
  FROM found w JOIN found o ON w.doc_id = o.doc_id AND o.s <= w.e + {SCOPE} AND o.e >= w.s - {SCOPE}
  WHERE w.kind >= 3 GROUP BY ALL),
reported AS (
  SELECT doc_id, kind, name, s, e FROM found WHERE kind < 3
  UNION ALL SELECT doc_id, kind, name, s, e FROM near
  WHERE NOT inside AND CASE kind WHEN 3 THEN secret WHEN 4 THEN identifier ELSE identifier AND secret END)
SELECT d.doc_id,
  count(*) FILTER (r.kind = 0) AS n_assign, count(*) FILTER (r.kind = 1) AS n_access, count(*) FILTER (r.kind = 2) AS n_hex,
  sha256(coalesce(string_agg(name || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind) FILTER (r.kind < 3), '')) AS base_sha256,
  coalesce(string_agg(name || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind) FILTER (r.kind IS NOT NULL), '') AS spans
FROM documents d LEFT JOIN reported r ON d.doc_id = r.doc_id GROUP BY d.doc_id
"""
