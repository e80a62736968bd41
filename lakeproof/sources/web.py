"""Ranges and small texts over HTTP: never more bytes than asked for, a token for one host alone, patience with busy servers."""

from __future__ import annotations

import http.client
import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from email.message import Message
from typing import NamedTuple

# --- fixed values: the public model hub's host, the variable that holds its token, and what is tried again ---
TOKEN_HOST, TOKEN_VARIABLE = "huggingface.co", "HF_TOKEN"
TOKEN_SCHEMES = ("https",)
BUSY = (429, 500, 502, 503, 504)

TRIES, PAUSE, LONGEST_PAUSE, TIMEOUT = 6, 1.5, 120.0, 60.0


class NoRanges(OSError):
    """The server gives files from their beginning alone."""


def headers_for(url: str, token: str | None = None) -> dict[str, str]:
    """Request headers: the token goes to its own host, over an encrypted connection, and to no other."""
    token = os.environ.get(TOKEN_VARIABLE) if token is None else token
    at = urllib.parse.urlsplit(url)
    host = at.hostname if at.port is None else f"{at.hostname}:{at.port}"
    return {"Authorization": f"Bearer {token}"} if token and host == TOKEN_HOST and at.scheme in TOKEN_SCHEMES else {}


class _Redirects(urllib.request.HTTPRedirectHandler):
    """A redirected request carries what its new address may have: the token stays with its host."""

    def __init__(self, token: str | None):
        self.token = token

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        new = super().redirect_request(req, fp, code, msg, headers, newurl)
        if new is not None:
            new.remove_header("Authorization")
            for name, value in headers_for(newurl, self.token).items():
                new.add_header(name, value)
        return new


def _pause(headers: Message, attempt: int) -> float:
    """Seconds to wait before the next try: what the server says, by either header, else ever longer."""
    told = re.fullmatch(r"\d+(\.\d+)?", (headers.get("Retry-After") or "").strip())
    reset = re.search(r"(?:^|;)\s*t=(\d+)\s*(?:;|$)", headers.get("RateLimit") or "")
    return min(LONGEST_PAUSE, max(1.0, float(told[0])) if told else float(reset[1]) + 1 if reset else PAUSE * 2**attempt)


def opened(url: str, at: int | None = None, most: int | None = None, token: str | None = None, sleep: Callable[[float], None] = time.sleep, turn: Callable[[], None] | None = None, tries: int | None = None):
    """An open answer, or the error of an answer that is final; what is read of it is up to the caller. ``turn`` is called before each try."""
    asked = headers_for(url, token) | ({"Range": f"bytes={at}-{'' if most is None else at + most - 1}"} if at is not None else {})
    opener, tries = urllib.request.build_opener(_Redirects(token)), tries or TRIES
    for attempt in range(tries):
        if turn is not None:
            turn()
        try:
            return opener.open(urllib.request.Request(url, headers=asked), timeout=TIMEOUT)
        except urllib.error.HTTPError as e:
            if e.code not in BUSY or attempt + 1 == tries:
                return e
            wait = _pause(e.headers, attempt)
            e.close()
            sleep(wait)
        except (urllib.error.URLError, TimeoutError, ConnectionError, http.client.HTTPException) as e:
            if attempt + 1 == tries:
                raise OSError(f"cannot reach {url}: {e}") from e
            sleep(min(LONGEST_PAUSE, PAUSE * 2**attempt))
    raise AssertionError("unreachable")


def get(url: str, most: int, at: int | None = None, token: str | None = None, sleep: Callable[[float], None] = time.sleep, turn: Callable[[], None] | None = None, tries: int | None = None) -> tuple[int, Message, bytes]:
    """(status, headers, body) with at most ``most`` bytes of body, from ``at`` on if that is given.

    Busy answers are waited for; others from 400 on are returned. Where a server would send what comes before ``at`` too, nothing is read and NoRanges raised. A body that
    breaks off is asked for again.
    """
    tries = tries or TRIES
    for attempt in range(tries):
        with opened(url, at, most if at is not None else None, token, sleep, turn, tries) as answer:
            if answer.status >= 400:
                return answer.status, answer.headers, b""
            if at and answer.status != 206:
                raise NoRanges(f"{url} is not given by ranges")
            try:
                body = _read(answer, most)
            except (http.client.HTTPException, TimeoutError, ConnectionError) as e:
                if attempt + 1 == tries:
                    raise OSError(f"{url} breaks off: {e}") from e
                sleep(min(LONGEST_PAUSE, PAUSE * 2**attempt))
                continue
            return answer.status, answer.headers, body
    raise AssertionError("unreachable")


def _read(answer, most: int) -> bytes:
    """At most ``most`` bytes of a body; one that ends before its stated length is an error."""
    body = answer.read(most)
    stated = answer.headers.get("Content-Length") or ""
    if stated.isdigit() and len(body) < min(most, int(stated)):
        raise http.client.IncompleteRead(body, min(most, int(stated)) - len(body))
    return body


class WebFile:
    """A file at a URL; a beginning that was fetched isn't fetched again.

    It's read by ranges, or, from a server that has none, by reading on in the one answer that is open.
    """

    def __init__(self, url: str, turn: Callable[[], None] | None = None, token: str | None = None, tries: int | None = None):
        self.url, self.head, self.token, self.whole = url, b"", token, None
        self.how: dict = {"turn": turn, "tries": tries}
        answer = opened(url, 0, 1, token, **self.how)
        if answer.status >= 400:
            answer.close()
            raise OSError(f"HTTP {answer.status} for {url}")
        total = (answer.headers.get("Content-Range") or "").rpartition("/")[2]
        length = answer.headers.get("Content-Length") or ""
        if answer.status == 206 and total.isdigit():
            self.size = int(total)
            self.head = answer.read(1)
            answer.close()
        elif length.isdigit():
            self.size, self.whole = int(length), answer
        else:
            answer.close()
            raise OSError(f"{url} does not tell its size")

    def read(self, at: int, n: int) -> bytes:
        end = min(at + n, self.size)
        while len(self.head) < end and (at == 0 or self.whole is not None):
            if self.whole is not None:
                if at > len(self.head):
                    raise NoRanges(f"{self.url} is not given by ranges")
                more = self.whole.read(end - len(self.head))
            else:
                status, _, more = get(self.url, end - len(self.head), len(self.head), self.token, **self.how)
                if status >= 400:
                    raise OSError(f"HTTP {status} for {self.url}")
            if not more:
                raise OSError(f"{self.url} breaks off")
            self.head += more
        if end <= len(self.head):
            return self.head[at:end]
        status, _, out = get(self.url, end - at, at, self.token, **self.how)
        if status >= 400:
            raise OSError(f"HTTP {status} for {self.url}")
        return out

    def close(self) -> None:
        if self.whole is not None:
            self.whole.close()


class Fetched(NamedTuple):
    """What came of asking for a text: ok, absent, over_cap, refused (with the HTTP status) or unreachable; the text of ok alone, the reason of the others."""

    status: str
    http: int | None
    text: str | None
    error: str | None


def fetch_text(url: str, most: int, token: str | None = None, turn: Callable[[], None] | None = None, sleep: Callable[[float], None] = time.sleep, tries: int | None = None) -> Fetched:
    """A small text file of at most ``most`` bytes."""
    try:
        status, _, body = get(url, most + 1, None, token, sleep, turn, tries)
    except (OSError, ValueError) as e:
        return Fetched("unreachable", None, None, str(e))
    if status == 404:
        return Fetched("absent", status, None, "there is no such file")
    if status >= 400:
        return Fetched("refused", status, None, f"HTTP {status}")
    if len(body) > most:
        return Fetched("over_cap", status, None, f"longer than {most} bytes")
    return Fetched("ok", status, body.decode("utf-8", errors="replace"), None)


def text(url: str, most: int) -> str | None:
    """A small text file; null where there is none, it is longer than ``most`` bytes or the server refuses it. A server out of reach is an error."""
    got = fetch_text(url, most)
    if got.status == "unreachable":
        raise OSError(got.error)
    return got.text


def pages(url: str, most: int = 64 << 20) -> Iterator[tuple[str, str | None, str]]:
    """(url, next_url, body) of a catalogue that names each following page in a Link header; a page that comes again is an error."""
    seen = set()
    here: str | None = url
    while here:
        if here in seen:
            raise ValueError(f"the catalogue leads back to {here}")
        seen.add(here)
        status, headers, body = get(here, most)
        if status >= 400:
            raise OSError(f"HTTP {status} for {here}")
        following = next((p.split(";")[0].strip(" <>") for p in (headers.get("Link") or "").split(",") if 'rel="next"' in p), None)
        if not json.loads(body or b"[]"):
            return
        yield here, following, body.decode("utf-8", errors="replace")
        here = following
