"""Keyed state with event-time timers: requests that expire after their batch, receipts that are audited after theirs.

Ids are dealt by a hash into BUCKETS groups. A group's state is a table of the ids that are
undecided or may still come again, with one timer at the least deadline; a batch's rows are
folded into it by columns, so Python is called once per group and batch, never once per id.
An id is decided once, and leaves when the watermark has passed its deadline. Nothing is
re-read: a decision needs the id's state and the rows of the batch alone. A batch rewrites the
tables of the groups it touches or whose timer is due: more buckets make them smaller.

Defined cases: rows of an id may come in any order within the watermark's delay, and more
than once; the least deadline and the earliest close count. A row later than the delay is
dropped. Null ids are one id. An open row without a deadline never expires and is decided by
its close alone. Ids that are still open when a finite stream ends are not reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPEN, CLOSE = "open", "close"
#: Days that an outbox row waits for its audit.
RETENTION = "30 days"
#: Groups of ids that share a state.
BUCKETS = 128
#: A time that never comes.
NEVER = np.iinfo("int64").max
#: Types of ids and references that are held as longs; others are held as text.
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _held(id_type: str, ref_type: str) -> pa.Schema:
    """What is held of an id: its least deadline, its earliest close with the reference, and whether it is decided."""
    id_, ref = (pa.int64() if kind in INTEGERS else pa.string() for kind in (id_type, ref_type))
    return pa.schema([("id", id_), ("opened", pa.bool_()), ("deadline", pa.int64()), ("closed", pa.int64()), ("ref", ref), ("ref_known", pa.bool_()), ("done", pa.bool_())])


def _unpacked(state: GroupState, schema: pa.Schema) -> dict[str, np.ndarray]:
    """The ids that a group holds, by columns."""
    held = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else schema.empty_table()
    return {name: held.column(name).to_numpy() for name in schema.names}


def _packed(held: dict[str, np.ndarray], schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(pa.record_batch([pa.array(held[f.name], f.type) for f in schema], schema=schema))
    return sink.getvalue().to_pybytes()


def _folded(held: dict[str, np.ndarray], rows: pd.DataFrame) -> dict[str, np.ndarray]:
    """One row per id of what is held and what has come; touched: the batch has rows of the id."""
    put = lambda name: np.concatenate([held[name], rows[name].to_numpy()])
    code, ids = pd.factorize(put("id"))
    n, old = len(ids), len(held["id"])
    any_of = lambda flags, of=code: np.bincount(of[flags], minlength=n) > 0
    closed, deadline = put("closed"), np.full(n, NEVER)
    np.minimum.at(deadline, code, put("deadline"))
    first = np.lexsort((closed, code))  # stable: of equal closes the one that came first
    first = first[np.r_[True, code[first][1:] != code[first][:-1]]]
    return {
        "id": ids, "opened": any_of(put("opened")), "deadline": deadline, "closed": closed[first], "ref": put("ref")[first], "ref_known": put("ref_known")[first],
        "done": any_of(held["done"], code[:old]), "touched": np.bincount(code[old:], minlength=n) > 0,
    }


def _plain(value: Column, kind: str) -> Column:
    """A value as a long or as text, zero or empty for null: columns of numbers with nulls would be rounded on their way to pandas."""
    if kind in INTEGERS:
        return F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))
    return F.coalesce(F.base64(value) if kind == "binary" else value.cast("string"), F.lit(""))


def _from_plain(value: Column, kind: str) -> Column:
    return F.unbase64(value) if kind == "binary" else value.cast(kind)


def stream_settled(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(id, outcome, at, ref): once per opened id, `closed` before its deadline or `expired` at it.

    rows (id, kind, at, deadline, ref) with a watermark on at: kind `open` brings the
    deadline, kind `close` ends it and may bring a reference.
    """
    id_type, ref_type = (rows.schema[c].dataType.simpleString() for c in ("id", "ref"))
    schema = _held(id_type, ref_type)
    kind_is = lambda kind: F.coalesce(F.col("kind") == kind, F.lit(False))
    millis = lambda kind, time: F.coalesce(F.when(kind_is(kind), F.unix_millis(time)), F.lit(int(NEVER)))
    # Null ids have a group of their own, so that no column of a group has nulls.
    bucket = F.when(F.col("id").isNull(), F.lit(buckets).cast("bigint")).otherwise(F.pmod(F.xxhash64("id"), F.lit(buckets)))
    source = rows.select(
        bucket.alias("bucket"), "at", _plain(F.col("id"), id_type).alias("id"), kind_is(OPEN).alias("opened"), millis(OPEN, "deadline").alias("deadline"), millis(CLOSE, "at").alias("closed"),
        _plain(F.col("ref"), ref_type).alias("ref"), (kind_is(CLOSE) & F.col("ref").isNotNull()).alias("ref_known"),
    )

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, held = state.getCurrentWatermarkMs(), _unpacked(state, schema)
        if state.hasTimedOut:
            rows = held | {"touched": np.zeros(len(held["id"]), "bool")}
        else:
            rows = _folded(held, pd.concat(list(batches), ignore_index=True))
        opened, deadline, closed, touched = (rows[c] for c in ("opened", "deadline", "closed", "touched"))
        waits = opened & ~rows["done"]
        ended = waits & (closed != NEVER)
        # Without rows of its own an id expires by its timer, which is due after its time.
        expired = np.where(ended, deadline <= closed, waits & (deadline != NEVER) & ((deadline < now) | (touched & (deadline == now))))
        told = ended | expired
        rows["done"] = rows["done"] | told
        # A close without its open, and a decided id, wait only for what may still come.
        until = np.where(opened, deadline, closed)
        kept = ((until > now) | (~touched & (until == now))) & ~((until == NEVER) & (rows["done"] | ~opened))
        timers = until[kept & (until != NEVER)]
        if kept.any():
            state.update((_packed({c: rows[c][kept] for c in schema.names}, schema),))
            if len(timers):
                state.setTimeoutTimestamp(int(max(timers.min(), 1)))
        elif state.exists:
            state.remove()
        if told.any():
            late = expired[told]
            yield pd.DataFrame({
                "id": rows["id"][told], "id_known": key[0] != buckets, "expired": late, "at_ms": np.where(late, deadline[told], closed[told]), "ref": rows["ref"][told], "ref_known": rows["ref_known"][told] & ~late,
            })

    id_as, ref_as = ("bigint" if kind in INTEGERS else "string" for kind in (id_type, ref_type))
    told = f"id {id_as}, id_known boolean, expired boolean, at_ms bigint, ref {ref_as}, ref_known boolean"
    settled = source.groupBy("bucket").applyInPandasWithState(step, told, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    value = lambda name, kind: F.when(F.col(f"{name}_known"), _from_plain(F.col(name), kind)).alias(name)
    return settled.select(value("id", id_type), F.when(F.col("expired"), "expired").otherwise("closed").alias("outcome"), F.timestamp_millis("at_ms").alias("at"), value("ref", ref_type))


def stream_expiry(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(id, outcome, at) of requests (id, kind, at, deadline): expired at the deadline, unless closed before it."""
    return stream_settled(requests.withWatermark("at", delay).withColumn("ref", F.lit(None).cast("bigint"))).drop("ref")


def stream_outbox(outbox: DataFrame, audits: DataFrame, retention: str = RETENTION, delay: str = "1 day") -> DataFrame:
    """(seq, delivered, audit_seq, at) once per outbox row (seq, at): delivered by its audit (seq, audit_seq, at), or not within the retention.

    The audit may come in any later batch; repeated audits deliver nothing again. The
    watermark is that of the slower stream.
    """
    waiting = outbox.withWatermark("at", delay).select(
        F.col("seq").alias("id"), F.lit(OPEN).alias("kind"), "at", (F.col("at") + F.expr(f"INTERVAL {retention}")).alias("deadline"), F.lit(None).cast("bigint").alias("ref")
    )
    answered = audits.withWatermark("at", delay).select(
        F.col("seq").alias("id"), F.lit(CLOSE).alias("kind"), "at", F.lit(None).cast("timestamp").alias("deadline"), F.col("audit_seq").cast("bigint").alias("ref")
    )
    settled = stream_settled(waiting.union(answered))
    return settled.select(F.col("id").alias("seq"), (F.col("outcome") == "closed").alias("delivered"), F.col("ref").alias("audit_seq"), "at")
