"""Calls of remote services from tasks: bounded concurrency, a rate, back-off on quota, and no row lost."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StringType, StructType

from marlstone.operators.streams import small_batches


class QuotaExceeded(RuntimeError):
    """What a call may raise to be tried again later."""


def is_quota(error: Exception) -> bool:
    """A service's word that it is asked too much: QuotaExceeded, status 429, or a message of it."""
    return isinstance(error, QuotaExceeded) or 429 in (getattr(error, "code", None), getattr(error, "status", None)) or "Quota exceeded" in str(error) or "ResourceExhausted" in type(error).__name__


@dataclass(frozen=True)
class Limits:
    """What one task may ask of a service; a service's own quota is divided by the tasks that run at once.

    concurrent: calls under way at once. tries: calls that fail for another reason than quota. quota_tries, base, cap: waits
    after a refusal for quota are random up to base, 2 base, 4 base seconds and so on, but no longer than cap. rate: calls a
    second (None: any), of which burst may come at once."""

    concurrent: int = 4
    tries: int = 3
    quota_tries: int = 6
    base: float = 0.5
    cap: float = 30.0
    rate: float | None = None
    burst: int = 1


class Bucket:
    """Tokens that come at a rate; take() waits for one. Waiters are served in turn."""

    def __init__(self, rate: float | None, burst: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, max(1, burst), clock, sleep
        self.lock, self.tokens, self.at = threading.Lock(), float(max(1, burst)), clock()

    def take(self) -> None:
        if self.rate is None:
            return
        with self.lock:
            now = self.clock()
            self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate) - 1
            self.at = now
            wait = -self.tokens / self.rate
        if wait > 0:
            self.sleep(wait)


@dataclass
class Answer:
    value: Any = None
    error: str | None = None
    calls: int = 0


class Pool:
    """Calls a function for many inputs at once within Limits; closes with its `with` block."""

    def __init__(self, limits: Limits, retry: Callable[[Exception], bool] = is_quota, sleep: Callable[[float], None] = time.sleep):
        self.limits, self.retry, self.sleep = limits, retry, sleep
        self.bucket = Bucket(limits.rate, limits.burst, sleep=sleep)
        self.threads = ThreadPoolExecutor(max(1, limits.concurrent))

    def __enter__(self) -> Pool:
        return self

    def __exit__(self, *_) -> None:
        self.threads.shutdown(wait=True, cancel_futures=True)

    def one(self, call: Callable[[Any], Any], x: Any, tries: int | None = None) -> Answer:
        out, failed, refused = Answer(), 0, 0
        while True:
            self.bucket.take()
            out.calls += 1
            try:
                out.value, out.error = call(x), None
                return out
            except Exception as e:
                out.error = f"{type(e).__name__}: {e}"
                if self.retry(e):
                    refused += 1
                    if refused >= self.limits.quota_tries:
                        return out
                    self.sleep(random.uniform(0, min(self.limits.cap, self.limits.base * 2 ** (refused - 1))))
                else:
                    failed += 1
                    if failed >= (self.limits.tries if tries is None else tries):
                        return out

    def each(self, call: Callable[[Any], Any], inputs: Sequence[Any]) -> Iterator[Answer]:
        """An answer for each input, in their order."""
        return self.threads.map(lambda x: self.one(call, x), inputs)

    def blocks(self, call: Callable[[list], Sequence], inputs: Sequence[Any], size: int) -> Iterator[Answer]:
        """The same for a function of lists. A list that fails, or whose answer has another length, is halved, so that one bad
        input costs a few calls and not its block's answers; a list of one is tried as often as Limits say."""

        def checked(xs: list) -> list:
            got = list(call(xs))
            if len(got) != len(xs):
                raise ValueError(f"{len(got)} answers to {len(xs)} inputs")
            return got

        def answered(xs: list) -> list[Answer]:
            got = self.one(checked, xs, None if len(xs) == 1 else 1)
            if got.error is None:
                return [Answer(v, None, got.calls) for v in got.value]
            if len(xs) == 1:
                return [got]
            half = len(xs) // 2
            return answered(xs[:half]) + answered(xs[half:])

        for part in self.threads.map(answered, [list(inputs[i : i + size]) for i in range(0, len(inputs), size)]):
            yield from part


def called(rows: DataFrame, inputs: Sequence[str], out: str, call: Callable, limits: Limits = Limits(), size: int | None = None, retry: Callable[[Exception], bool] = is_quota, kind: str = "string", batch: int = 256) -> DataFrame:
    """`rows` with `out` (the answer, of type `kind`), `out`_error (the last error; null with an answer) and `out`_calls.

    `call` gets a row's `inputs` as a tuple, or with `size` a list of up to that many tuples, and must be fit for threads. Every
    row comes out once, with an answer or an error; what the service refuses costs waits, not rows. A task keeps `batch` rows under
    way, and one pool for all of them; how many tasks ask at once is the number of partitions that run at once.

    A task that is run again asks again: calls are made at least once. Null inputs are passed on as None. An answer that
    doesn't fit `kind` is an error. Raises if the table has one of the new columns."""
    small_batches(rows.sparkSession)
    new = [out, f"{out}_error", f"{out}_calls"]
    clash = [c for c in new if c in rows.columns]
    if clash:
        raise ValueError(f"the table has {', '.join(clash)} already")
    field = rows.sparkSession.range(0).select(F.lit(None).cast(kind).alias("x")).schema["x"].dataType
    arrow = to_arrow_type(field)
    schema = StructType([*rows.schema.fields]).add(out, field).add(new[1], StringType()).add(new[2], IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Pool(limits, retry) as pool:
            for whole in batches:
                for start in range(0, whole.num_rows, batch):
                    b = whole.slice(start, batch)
                    asked = list(zip(*[b.column(c).to_pylist() for c in inputs]))
                    got = list(pool.each(call, asked) if size is None else pool.blocks(call, asked, size))
                    values = []
                    for a in got:
                        try:
                            values.append(pa.scalar(a.value, arrow))
                        except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError) as e:
                            a.error = f"{type(e).__name__}: {e}"
                            values.append(pa.scalar(None, arrow))
                    columns = [pa.array([v.as_py() for v in values], arrow), pa.array([a.error for a in got], pa.string()), pa.array([a.calls for a in got], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *new])

    return rows.mapInArrow(run, schema)
