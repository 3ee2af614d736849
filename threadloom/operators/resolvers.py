"""Resolvers that ask a patch tracker over HTTP: functions of a message id that give its state, or None.

Both kinds take ``get``, so that tests and other transports can stand in for the network.
"""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from threadloom.operators.enrich import STATE_NAMES, with_retries

Answer = tuple[int, str | None, str]  # status, where it points, body


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def fetch(url: str, follow: bool = True, timeout: float = 30.0) -> Answer:
    """One request. Refusals for load (429), failures of the server and of the network are raised, all as OSError; any other status is an answer."""
    opener = urllib.request.build_opener(*([] if follow else [_Stay]))
    request = urllib.request.Request(url, headers={"User-Agent": "threadloom"})
    try:
        with opener.open(request, timeout=timeout) as reply:
            return reply.status, reply.headers.get("Location"), reply.read().decode(errors="replace")
    except urllib.error.HTTPError as e:
        if e.code == 429 or e.code >= 500:
            raise
        return e.code, e.headers.get("Location"), ""


def patient(get: Callable[..., Answer] = fetch, attempts: int = 4, base: float = 1.0) -> Callable[..., Answer]:
    """``get`` with waits of 1, 2, 4, ... times ``base`` seconds between attempts."""
    return with_retries(get, attempts, base)


def _parsed(answer: Answer):
    status, _, body = answer
    try:
        return json.loads(body) if status == 200 and body else None
    except ValueError:
        return None


def by_list(site: str, list_id: str, get: Callable[..., Answer] | None = None) -> Callable[[str], str | None]:
    """Of the patches that the site has for the message, the state of the first in the project with that list id."""
    get = get or patient()

    def ask(msgid):
        for patch in _parsed(get(f"{site}/api/patches/?{urllib.parse.urlencode({'msgid': msgid})}")) or []:
            if (patch.get("project") or {}).get("list_id") == list_id:
                return patch.get("state")
        return None

    return ask


def by_redirect(site: str, get: Callable[..., Answer] | None = None) -> Callable[[str], str | None]:
    """The site sends a message's address on to its patch, whose state is a number; one without a name is its number as text."""
    get = get or patient()

    def ask(msgid):
        status, there, _ = get(f"{site}/patch/msgid/{urllib.parse.quote(msgid, safe='')}/", False)
        number = re.search(r"/patch/(\d+)", there or "") if 300 <= status < 400 else None
        patch = _parsed(get(f"{site}/api/1.0/patches/{number[1]}/")) if number else None
        return STATE_NAMES.get(patch.get("state"), str(patch.get("state"))) if patch else None

    return ask
