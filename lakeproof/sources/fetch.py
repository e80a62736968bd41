"""Files of repositories fetched in parallel tasks, under one rate of requests for all of them.

The requests are any table, so this is a step of a plan and no source that would have to read that table by itself. Every request has a lane, told by a hash, and time
is cut into turns of a little more than one by the rate. The turns go round the lanes, and a lane's requests, retries included, wait for its own turns; so however many
tasks run, and wherever, no second has more requests than the rate, without any task knowing of another. That holds as far as the executors' clocks agree; of a lane
that is run twice at once (speculation, or an executor that was taken for lost) both runs take its turns. A lane that has nothing to ask for leaves its turns unused, so there should be no more lanes
than tasks that run at once.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.sources import gguf, web
from lakeproof.sources.staging import written

#: Requests a second, and by how much a turn is longer than its share, so that requests that arrive late don't crowd a second.
RATE, MARGIN = 14.0, 1.05
#: Bytes of texts that a task hands on at a time.
HANDED = 8 << 20
TEXTS = "repo string, file string, status string, http int, text string, error string"


class Lane:
    """The turns of one of several lanes that share a rate of requests a second."""

    def __init__(self, rate: float, lanes: int, lane: int, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        if rate <= 0 or lanes < 1:
            raise ValueError("a rate and a number of lanes above zero")
        self.width, self.lanes, self.lane, self.last = MARGIN / rate, lanes, lane % lanes, -1
        self.clock, self.sleep = clock, sleep

    def turn(self) -> None:
        """Wait for the lane's next turn."""
        now = self.clock()
        at = max(math.ceil(now / self.width), self.last + 1)
        self.last = at + (self.lane - at) % self.lanes
        self.sleep(max(0.0, self.last * self.width - now))


def _dealt(requests: DataFrame, lanes: int | None) -> tuple[DataFrame, int]:
    """The requests with a lane each, a partition for every lane."""
    n = lanes or max(1, requests.sparkSession.sparkContext.defaultParallelism)
    return requests.withColumn("lane", F.pmod(F.xxhash64("repo", "file"), F.lit(n)).cast("int")).repartitionById(n, "lane"), n


def fetched_texts(requests: DataFrame, rate: float = RATE, lanes: int | None = None, token: str | None = None, tries: int | None = None) -> DataFrame:
    """One row per request (repo, file, url, most: bytes at most): repo, file, status, http, text, error, in a written table, so that nothing is fetched twice.

    The status is ok, absent (404), over_cap, refused (another status from 400 on, after retries where the server is busy) or unreachable; only ok has a text. A null url or
    limit is refused without asking. Requests that are repeated are asked for each time; an empty table asks nothing. ``token`` stands in for the variable that holds it.
    """
    dealt, n = _dealt(requests.select("repo", "file", "url", F.col("most").cast("long").alias("most")), lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, Lane] = {}
        rows: list[tuple] = []
        size = 0
        names = [part.split()[0] for part in TEXTS.split(", ")]
        kinds = [pa.int32() if c == "http" else pa.string() for c in names]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for batch in batches:
            for repo, file, url, most, lane in zip(*(batch.column(c).to_pylist() for c in ("repo", "file", "url", "most", "lane"))):
                if url is None or most is None:
                    got = web.Fetched("refused", None, None, "no address or limit")
                else:
                    got = web.fetch_text(url, most, token, turns.setdefault(lane, Lane(rate, n, lane)).turn, tries=tries)
                rows.append((repo, file, *got))
                size += len(got.text or "")
                if size > HANDED or len(rows) >= 10_000:
                    yield pack()
                    rows, size = [], 0
        if rows:
            yield pack()

    return written(dealt.mapInArrow(run, TEXTS), "texts")


def fetched_headers(requests: DataFrame, rate: float = RATE, lanes: int | None = None, token: str | None = None, tries: int | None = None, ladder_mb: tuple[int, ...] = gguf.REMOTE_LADDER, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(models, metadata, tensors) as the source ``gguf`` has them, of the model files at (repo, file, url), by ranges that grow; model_id is the repository.

    A file that can't be reached, read or parsed is a models row with its parse_error. ``options`` are materialize, mode and keys of the parser. The rows are written once.
    """
    dealt, n = _dealt(requests.select("repo", "file", "url"), lanes)
    ddl, pack = gguf.header_packer(requests.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, Lane] = {}
        for batch in batches:
            for repo, url, lane in zip(*(batch.column(c).to_pylist() for c in ("repo", "url", "lane"))):
                error, header, size = None, gguf.Header(), None
                try:
                    file = web.WebFile(url or "", turns.setdefault(lane, Lane(rate, n, lane)).turn, token, tries)
                    try:
                        size = file.size
                        header = gguf.parse_prefixes(lambda m, f=file: f.read(0, m), size, [m << 20 for m in ladder_mb], **options)
                    finally:
                        file.close()
                except (gguf.HeaderError, OSError, ValueError) as e:
                    error, header = str(e), gguf.Header()
                yield pack(gguf.rows_of("headers", repo, size, header, None, error, False))

    return gguf.split_headers(written(dealt.mapInArrow(run, ddl), "headers"))
