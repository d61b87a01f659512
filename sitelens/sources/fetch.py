"""Live HTTP: GET a column of URLs into rows of the response relation. It never raises; what fails says how in `error`.

Hosts are dealt to tasks, so one host is asked by one task, one request after another.
"""

from __future__ import annotations

import http.client
import re
import socket
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.constants import BODY_BYTES
from sitelens.functions.urls import authority

AGENT = "sitelens/0.1"
TIMEOUT, ATTEMPTS, REDIRECTS = 15, 3, 10
#: Bytes read at a time, and answers held before they are handed on.
PART, HELD = 1 << 16, 10
RETRIED = (429, 500, 502, 503, 504)
SCHEMA = "domain string, url string, final_url string, status int, headers map<string,string>, text string, error string, truncated boolean"


def pause(status: int | None, retry_after: str | None, attempt: int) -> float:
    """Seconds before the next attempt."""
    if retry_after and re.fullmatch(r"\d+(\.\d+)?", retry_after.strip()):
        return min(120.0, float(retry_after))
    return 20.0 * (attempt + 1) if status == 429 else 0.5 * (attempt + 1)


def pause_column(status: Column, retry_after: Column, attempt: Column) -> Column:
    """The same over recorded responses."""
    told = F.try_to_number(F.trim(retry_after), F.lit("9999999")).cast("double")
    return F.when(told.isNotNull(), F.least(told, F.lit(120.0))).when(status == 429, 20.0 * (attempt + 1)).otherwise(0.5 * (attempt + 1))


def decode(body: bytes, content_type: str) -> str:
    found = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type, re.I)
    try:
        return body.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def unresolved(error: BaseException | None) -> bool:
    """Whether a failure goes back to a name that doesn't resolve; such a request isn't tried again."""
    while error is not None:
        if isinstance(error, socket.gaierror):
            return True
        reason = getattr(error, "reason", None)
        error = reason if isinstance(reason, BaseException) else error.__cause__ or error.__context__
    return False


def name_of(error: BaseException) -> str:
    """The kind of a failure."""
    if isinstance(error, TimeoutError) or isinstance(getattr(error, "reason", None), TimeoutError):
        return "timeout"
    if isinstance(error, (http.client.InvalidURL, ValueError)):
        return "unsupported_protocol" if "unknown url type" in str(error) else "invalid_url"
    if isinstance(error, urllib.error.HTTPError) and "redirect" in str(error).lower():
        return "too_many_redirects"
    if isinstance(error, urllib.error.URLError):
        if "unknown url type" in str(error.reason):
            return "unsupported_protocol"
        return f"network: {type(error.reason).__name__}"
    if isinstance(error, OSError):
        return f"network: {type(error).__name__}"
    if isinstance(error, http.client.HTTPException):
        return f"http: {type(error).__name__}"
    return "unknown"


def read_body(answer, encoding: str, limit: int = BODY_BYTES) -> tuple[bytes, bool]:
    """The body, unpacked as it comes and cut at so many unpacked bytes, and whether it had as many. One that isn't in the encoding
    named is taken as it is."""
    kinds = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(encoding.strip().lower(), ())
    first = answer.read(PART)
    for window in kinds:
        unpack, out, held, part = zlib.decompressobj(window), [], 0, first
        try:
            while part and held < limit and not unpack.eof:
                out.append(unpack.decompress(part, limit - held))
                held += len(out[-1])
                part = unpack.unconsumed_tail or answer.read(PART)
        except zlib.error:
            if not held:
                continue  # not in this encoding at all
        return b"".join(out)[:limit], held >= limit
    out, held = [first], len(first)
    while held < limit and (part := answer.read(PART)):
        out.append(part)
        held += len(part)
    return b"".join(out)[:limit], held >= limit


def fetch_one(url: str, open_: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> dict:
    row = {"url": url, "final_url": url, "status": None, "headers": {}, "text": "", "error": None, "truncated": False}
    for attempt in range(ATTEMPTS):
        try:
            request = urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept-Encoding": "gzip, deflate"})
            try:
                answer = open_(request, timeout=TIMEOUT)
            except urllib.error.HTTPError as e:
                if "redirect" in str(e).lower():
                    raise
                answer = e
            with answer:
                headers = {k.lower(): v for k, v in answer.headers.items()}
                body, cut = read_body(answer, headers.get("content-encoding", ""))
                row |= {"final_url": answer.geturl(), "status": answer.status, "headers": headers, "text": decode(body, headers.get("content-type", "")), "error": None, "truncated": cut}
        except Exception as e:
            row |= {"status": None, "error": name_of(e)}
            if unresolved(e) or row["error"] in ("invalid_url", "unsupported_protocol", "too_many_redirects"):
                return row
        if row["error"] is None and row["status"] not in RETRIED:
            return row
        if attempt + 1 < ATTEMPTS:
            sleep(pause(row["status"], row["headers"].get("retry-after"), attempt))
    return row


def fetch(requests: DataFrame, tasks: int = 4, stagger: float = 1.0) -> DataFrame:
    """Responses of requests (domain, url); `tasks` are at work at a time at most, and each starts so many seconds after the one
    before it. A task holds a few answers at a time."""
    names = ["domain", "url", "final_url", "status", "headers", "text", "error", "truncated"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        time.sleep(stagger * (context.partitionId() if context else 0))
        for frame in frames:
            rows: list[dict] = []
            for domain, url in zip(frame["domain"], frame["url"], strict=True):
                rows.append({"domain": domain} | fetch_one(url))
                if len(rows) == HELD:
                    yield pd.DataFrame(rows, columns=names).astype({"status": "Int64"})
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"status": "Int64"})

    return requests.select("domain", "url").repartition(tasks, authority(F.col("url"))).mapInPandas(run, SCHEMA)
