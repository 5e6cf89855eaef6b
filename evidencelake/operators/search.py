"""Searches run by branches: what is available is fused, and what is lost is named."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.operators import fusion
from evidencelake.operators.lineage import cut

#: How many hits a branch is asked for.
LEAST_CANDIDATES, MOST_CANDIDATES, PER_HIT, PER_CONGRESS = 30, 100, 4, 12

Branch = Callable[[], DataFrame]


class SearchError(RuntimeError):
    """No branch of a search is available."""


@dataclass(frozen=True)
class Search:
    """hits, the mode that made them, and the names of lost branches with what was wrong."""

    hits: DataFrame
    mode: str
    lost: dict[str, str] = field(default_factory=dict)


def candidates(k: int, congresses: int = 0) -> int:
    """Hits to ask each branch for, for ``k`` in the end."""
    return min(MOST_CANDIDATES, max(LEAST_CANDIDATES, PER_HIT * k, PER_CONGRESS * congresses))


def available(branches: dict[str, Branch]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The branches that can be made and read to the end, stored, and the errors of the others.

    A branch may fail when it is planned or only while its tasks run, so each is
    run once here, and its result is what is fused.
    """
    there, lost = {}, {}
    for name, branch in branches.items():
        try:
            there[name] = cut(branch())
        except Exception as e:
            lost[name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:200]
    return there, lost


def hybrid(keyword: Branch, vector: Branch, k: int, bonus: DataFrame | None = None) -> Search:
    """The ``k`` best hits of each query (query_id, id, keyword_rank, vector_rank, rrf_score, rank) of both branches (query_id, id, rank).

    If one branch is lost, the other's ranking stands and there is no fused score; if both are, SearchError says why.
    """
    there, lost = available({"keyword": keyword, "vector": vector})
    if len(there) == 2:
        return Search(fusion.fuse(there["keyword"], there["vector"], k, bonus), "hybrid_rrf")
    if not there:
        raise SearchError("keyword and vector search are both unavailable: " + "; ".join(lost.values()))
    (name, hits), none = next(iter(there.items())), F.lit(None).cast("int")
    ranks = {f"{n}_rank": F.col("rank").cast("int") if n == name else none for n in ("keyword", "vector")}
    kept = hits.where(F.col("rank") <= k).select("query_id", "id", *(c.alias(n) for n, c in ranks.items()), F.lit(None).cast("double").alias("rrf_score"), "rank")
    return Search(kept, f"{name}_only", lost)


def planned(keyword: Branch, vector: Branch, k: int, each: int) -> tuple[Search, DataFrame]:
    """The ``k`` best hits of each query over all its variants, and the variants that no keyword hit backs.

    The branches rank (query_id, variant, id); every variant is searched for ``each`` hits
    in the same two scans, and the variants' rankings are fused: query_id, id, variants, rrf_score, rank.
    """
    by_variant = lambda branch: lambda: branch().select(F.struct("query_id", "variant").alias("query_id"), "id", "rank")
    found = hybrid(by_variant(keyword), by_variant(vector), each)
    rows = cut(found.hits.select("query_id.query_id", "query_id.variant", "id", "keyword_rank", "rank"))
    asked = rows.select("query_id", "variant").distinct()
    mode = "planned_hybrid_rrf" if found.mode == "hybrid_rrf" else f"planned_{found.mode}"
    return Search(fusion.fuse_variants(rows, k), mode, found.lost), fusion.gaps(asked, rows)
