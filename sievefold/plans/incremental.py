"""Ingest whose work follows the batch: only touched buckets are merged, only touched
fingerprints clustered again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedupe import apply_marks, near_duplicates
from ..operators.store import scratch, store
from ..operators.tables import BUCKETS, Commit
from .ingest import KEPT

LISTINGS, PLACES = "listings", "places"
#: What near duplicates are found by; a table of its own, in buckets by fingerprint.
PLACE_COLUMNS = ("id", "dedupe_hash", "content_fingerprint", "first_seen_at", "latitude", "longitude", "location_suburb", "duplicate_of")


def merge_batch(tx: Commit, prepared: DataFrame, buckets: int = BUCKETS) -> dict[str, int]:
    """Merges prepared listings (of ``ingest.prepare``, with ``duplicate_of``) and marks near
    duplicates; returns how many rows of ``examined`` fingerprints were clustered and how
    many marks ``changed``.

    A listing whose title or company changed leaves its old fingerprint, so that is clustered
    again too.  The marks equal those of ``near_duplicates`` over the whole table."""
    with scratch():
        batch = store(prepared)
        keys = batch.select("dedupe_hash")
        fresh = not tx.has(LISTINGS)
        if fresh:
            tx.create(LISTINGS, batch.schema, ["dedupe_hash"], buckets)
            tx.create(PLACES, batch.select(*PLACE_COLUMNS).schema, ["content_fingerprint"], buckets)
        before = store(tx.rows_of(LISTINGS, keys, "dedupe_hash").select("id", "dedupe_hash", "content_fingerprint", "duplicate_of"))
        tx.merge(LISTINGS, batch, "dedupe_hash", KEPT)
        after = store(tx.rows_of(LISTINGS, keys, "dedupe_hash").select(*PLACE_COLUMNS))
        prints = store(before.select("content_fingerprint").union(after.select("content_fingerprint")).where("content_fingerprint IS NOT NULL").distinct())
        # a listing that lost its fingerprint duplicates nothing
        lost = after.where("content_fingerprint IS NULL AND duplicate_of IS NOT NULL").select("dedupe_hash", F.lit(None).cast(dict(batch.dtypes)["duplicate_of"]).alias("duplicate_of"))
        into = tx.touched(PLACES, tx._widened(prints, tx.manifest["tables"][PLACES]))
        held = tx.read_buckets(PLACES, into).join(after.select("dedupe_hash"), "dedupe_hash", "left_anti")
        rows = store(held.select(*PLACE_COLUMNS).union(after.where("content_fingerprint IS NOT NULL")))
        again = store(rows.join(prints, "content_fingerprint", "left_semi").select(*PLACE_COLUMNS))
        marked = store(apply_marks(again, near_duplicates(again)))
        if into:
            others = rows.join(prints, "content_fingerprint", "left_anti").select(*PLACE_COLUMNS)
            tx.put(PLACES, others.union(marked.select(*PLACE_COLUMNS)), into)
        changed = marked.where("changed").select("dedupe_hash", "duplicate_of").union(lost)
        n = changed.count()
        if n:
            tx.merge(LISTINGS, changed, "dedupe_hash")
        return {"examined": again.count(), "changed": n}
