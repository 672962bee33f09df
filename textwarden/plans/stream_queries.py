"""Queries on what streams compute, over whole tables: coalesced requests, the ring, the ledger and the re-sync."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textwarden.plans.common import Query
from textwarden.sources.writers import shared
from textwarden.streaming import coalesce, dedupe, ledger

_BUSY = 3600


def _jobs(t, spark):
    return coalesce.jobs(t("clicks").select("client_id", "ts"), ["client_id"], "ts", _BUSY)


_JOBS = f"""WITH k AS (SELECT client_id, list(struct_pack(at := epoch_us(ts), starts := [epoch_us(ts)]) ORDER BY ts) AS xs FROM clicks WHERE ts IS NOT NULL GROUP BY client_id),
    s AS (SELECT client_id, xs, list_reduce(xs, lambda acc, x: struct_pack(at := CASE WHEN x.at >= acc.at + {_BUSY}000000 THEN x.at ELSE acc.at END, starts := CASE WHEN x.at >= acc.at + {_BUSY}000000 THEN list_append(acc.starts, x.at) ELSE acc.starts END)).starts AS starts FROM k),
    j AS (SELECT client_id, unnest(starts) AS job_start FROM s)
    SELECT j.client_id, job_start, count(c.ts) - 1 AS merged FROM j JOIN clicks c ON c.client_id IS NOT DISTINCT FROM j.client_id AND epoch_us(c.ts) >= job_start AND epoch_us(c.ts) < job_start + {_BUSY}000000 GROUP BY j.client_id, job_start"""

_RING = """WITH k AS (SELECT conv_id, list(struct_pack(t := coalesce(text, chr(0)), last := [coalesce(text, chr(0))], out := [turn]) ORDER BY turn) AS xs FROM conversations GROUP BY conv_id),
    r AS (SELECT conv_id, list_reduce(xs, lambda acc, x: struct_pack(t := x.t, last := CASE WHEN list_contains(acc.last, x.t) THEN acc.last ELSE list_append(acc.last, x.t)[-3:] END, out := CASE WHEN list_contains(acc.last, x.t) THEN acc.out ELSE list_append(acc.out, x.out[1]) END)).out AS turns FROM k)
    SELECT conv_id, unnest(turns) AS turn FROM r"""


def _ledger(t, spark):
    """The clicks in four batches, of which one comes again, one was torn, and two share rows: each click is there once."""
    path, d = f"{shared(spark)}/ledger-{uuid.uuid4().hex}", t("clicks").where("click_id IS NOT NULL").select("click_id", "kind")
    write = ledger.writer(path, "click_id")
    write(d.where("click_id % 4 = 0"), 0)
    d.where("click_id % 4 = 1").limit(5).selectExpr("*", "'' AS _rank", "3 AS bucket", "1 AS epoch").write.partitionBy("bucket", "epoch").mode("append").parquet(f"{path}/data")  # torn
    write(d.where("click_id % 4 IN (0, 1)"), 1)
    write(d.where("click_id % 4 = 1"), 1)
    write(d.where("click_id % 4 >= 2"), 2)
    return ledger.read(spark, path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("click_id").alias("ids"))


_LEDGER = "SELECT kind, count(*) AS n, sum(click_id)::BIGINT AS ids FROM (SELECT DISTINCT ON (click_id) click_id, kind FROM clicks WHERE click_id IS NOT NULL ORDER BY click_id, kind) GROUP BY kind"

_COLS = ["source", "segment", "city", "balance"]


def _resync(t, spark):
    """What makes ``clients`` equal to the last state of each client in ``client_changes``."""
    last = t("client_changes").where("client_id IS NOT NULL").selectExpr("*", "row_number() OVER (PARTITION BY client_id ORDER BY seq DESC NULLS LAST, change_id DESC) AS r").where("r = 1 AND op <> 'D'")
    return ledger.changes(last.select("client_id", *_COLS), t("clients").where("client_id IS NOT NULL").select("client_id", *_COLS), ["client_id"], _COLS)


_RESYNC = """WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY seq DESC NULLS LAST, change_id DESC) AS r FROM client_changes WHERE client_id IS NOT NULL) WHERE r = 1 AND op <> 'D'),
    c AS (SELECT * FROM clients WHERE client_id IS NOT NULL)
    SELECT coalesce(s.client_id, c.client_id) AS client_id, CASE WHEN c.client_id IS NULL THEN 'insert' WHEN s.client_id IS NULL THEN 'delete' ELSE 'update' END AS what, s.source, s.segment, s.city, s.balance
    FROM s FULL JOIN c ON s.client_id = c.client_id WHERE s.client_id IS NULL OR c.client_id IS NULL OR s.source IS DISTINCT FROM c.source OR s.segment IS DISTINCT FROM c.segment OR s.city IS DISTINCT FROM c.city OR s.balance IS DISTINCT FROM c.balance"""

QUERIES = {
    "coalesced_requests": Query(_jobs, _JOBS),
    "dedupe_last3": Query(lambda t, spark: dedupe.last_three(t("conversations").select("conv_id", "turn", "text"), "conv_id", "turn").where("analysed").select("conv_id", "turn"), _RING),
    "ledger_rows": Query(_ledger, _LEDGER),
    "resync_changes": Query(_resync, _RESYNC),
}
