"""Secret scan in DataFrame operations alone, with corpus-wide ownership frequency.

A text is split by a kind's pattern: the lengths of what lies between matches, and of
the matches, are its places. Places become rows, and running sums over the rows of a
document are offsets, so the work grows with the matches alone. Each match's hash is
then counted over the distinct repositories and owners that hold it: a string that many
owners share is a copied example, one that a single owner holds looks live.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import column, materialise, send_back


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that is the secret, characters that it has at least, a string that every match has, and what is no part of the secret."""

    pattern: str
    group: int
    least: int
    has: str = ""
    dropped: str | None = None


#: Base kinds.
BASE = {
    "assign": Kind(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": Kind(r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    "hex": Kind(r"[0-9a-f]{24,}", 0, 24),
}
#: White space as it stands in a key or escaped in a string literal; the words before "PRIVATE KEY"; the end of a key; what is left of one that is cut off.
_SPACE, _WORDS = r"(?:\s|\\[nrt])", "(?:(?!PRIVATE KEY)[A-Z0-9]+ )*+"
_KEY_END = rf"-----END {_WORDS}PRIVATE KEY-----"
_KEY_LINES = rf"(?:{_SPACE}++(?:(?:Proc-Type|DEK-Info): [A-Za-z0-9,-]++|[A-Za-z0-9+/=]{{16,}}+))*+"
#: Kinds that the method adds. The secret of a key is its body, without white space.
ADDED = {
    "private_key": Kind(rf"-----BEGIN {_WORDS}PRIVATE KEY-----((?:[^-]++|-(?!----))*+(?={_KEY_END})|{_KEY_LINES})(?:{_KEY_END})?", 1, 1, "PRIVATE KEY-----", _SPACE),
    "forge": Kind(r"(?:ghp|gho|ghs|ghu|glpat)[_-][A-Za-z0-9_-]{20,}", 0, 24),
    "jwt": Kind(r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}", 0, 28, "eyJ"),
    "url_password": Kind(r"[a-z][a-z0-9+.-]++://[^\s:@/]++:[^\s:@/]{3,}+@", 0, 8, "://"),
}
#: A secret that at least so many owners hold is an example.
EXAMPLE_OWNERS = 3

KINDS = BASE | ADDED
PLACES = "array<struct<rank:int,nth:int,gap:bigint,size:bigint,hash:string>>"


def places(text: Column, rank: int, kind: Kind) -> Column:
    """The leftmost matches of a kind that don't overlap, in order: characters before each and after the last one, its own, its secret's hash.

    The hash is null where the secret is too short. It is taken without what matches
    dropped; where nothing else is in the secret, the whole match stands for it.
    """

    def secret(whole: Column) -> Column:
        own = F.regexp_extract(whole, kind.pattern, kind.group) if kind.group else whole
        return own if kind.dropped is None else F.coalesce(F.nullif(F.regexp_replace(own, kind.dropped, ""), F.lit("")), whole)

    found = F.zip_with(
        F.split(text, kind.pattern, -1),
        F.transform(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda m: F.struct(F.char_length(m).cast("bigint").alias("size"), secret(m).alias("secret"))),
        lambda gap, m: F.struct(F.char_length(gap).cast("bigint").alias("gap"), m["size"].alias("size"), F.when(F.char_length(m["secret"]) >= kind.least, F.sha2(m["secret"], 256)).alias("hash")),
    )
    rows = F.transform(found, lambda p, i: F.struct(F.lit(rank).alias("rank"), i.alias("nth"), p["gap"].alias("gap"), p["size"].alias("size"), p["hash"].alias("hash"))).cast(PLACES)
    met = text.rlike(kind.pattern)
    return F.when(F.contains(text, F.lit(kind.has)) & met if kind.has else met, F.filter(rows, lambda p: p["size"].isNotNull())).otherwise(F.array().cast(PLACES))


def find_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "source", repo: str | None = "lang") -> DataFrame:
    """row, id, owner, repo, places: one row for each row of docs, without its text.

    A null text counts as empty. Owners and repositories may be null: together they count
    as one more. row is a number of its own for each row.
    """
    whose = F.coalesce(column(owner).cast("string"), F.lit(""))
    named = docs.select(
        column(id_col).alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"), whose.alias("owner"),
        F.concat_ws("/", whose, F.coalesce(column(repo).cast("string"), F.lit("")) if repo else F.lit("")).alias("repo"),
    )
    found = F.concat(*[places(F.col("text"), i, kind) for i, kind in enumerate(KINDS.values())])
    return named.select(F.monotonically_increasing_id().alias("row"), "id", "owner", "repo", found.alias("places"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "source", repo: str | None = "lang", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row for each row of docs: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, max_owners, max_repos.

    Spans are sorted by start, then kind as listed; offsets are code points, the end
    exclusive. n_live and n_example count the spans whose secret fewer than, or at least,
    example_owners distinct owners hold; max_owners is the most owners of a span's
    secret (0 without spans). A secret that occurs twice in a row counts twice.
    Repeated rows give repeated results; an empty table gives an empty one; null ids
    are kept. Documents without matches never meet a shuffle of places: hashes are
    combined by (hash, owner, repository) in each task, merged, and sent back by salted keys.
    """
    rows = materialise(find_places(docs, id_col, text_col, owner, repo), "secret-places")
    every = rows.where("size(places) > 0").select("row", "owner", "repo", F.explode("places").alias("p")).repartition("row")
    end = F.sum(F.col("p.gap") + F.col("p.size")).over(Window.partitionBy("row", "p.rank").orderBy("p.nth"))
    spans = every.select("row", "owner", "repo", "p.rank", (end - F.col("p.size")).alias("start"), end.alias("end"), "p.hash").where("hash IS NOT NULL")
    spans = materialise(spans, "secret-spans")
    holders = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = holders.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    facts = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    live = (F.col("owners") < example_owners).cast("bigint")
    span = F.struct("start", "rank", "end")
    n_base = [F.sum((F.col("rank") == i).cast("bigint")).alias(f"n_{kind}") for i, kind in enumerate(BASE)]
    told = send_back(spans.select("row", "rank", "start", "end", "hash"), "hash", facts).groupBy("row").agg(
        *n_base, F.array_sort(F.collect_list(F.when(F.col("rank") < len(BASE), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("every"),
        F.sum(live).alias("n_live"), F.sum(1 - live).alias("n_example"), F.max("owners").alias("max_owners"), F.max("repos").alias("max_repos"),
    )
    out = [*[f"n_{kind}" for kind in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"), "n_live", "n_example", "max_owners", "max_repos"]
    with_spans = rows.where("size(places) > 0").select("row", "id").join(told, "row", "left").na.fill(0, [*[f"n_{kind}" for kind in BASE], "n_live", "n_example", "max_owners", "max_repos"])
    none = "array<struct<start:bigint,rank:int,end:bigint>>"
    with_spans = with_spans.withColumns({c: F.coalesce(c, F.array().cast(none)) for c in ("base", "every")}).select(F.col("id").alias(id_col), *out)
    zero = F.lit(0).cast("bigint")
    without = rows.where("size(places) = 0").select(
        F.col("id").alias(id_col), *[zero.alias(f"n_{kind}") for kind in BASE], F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), *[zero.alias(c) for c in ("n_live", "n_example", "max_owners", "max_repos")]
    )
    return with_spans.unionByName(without)
