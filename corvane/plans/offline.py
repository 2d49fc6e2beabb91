"""Stand-ins for services, for the registered queries of source clients: answers that follow from the request alone, with the
errors, limits and pages that the clients have to cope with. A first attempt fails, its repeat succeeds."""

from __future__ import annotations

import base64
import json
import re
from collections import Counter

from corvane.sources.paged import Response

_TRIED: Counter = Counter()


def first_try(key: object) -> bool:
    """Whether the worker meets this request for the first time (or again after it succeeded)."""
    _TRIED[key] += 1
    if _TRIED[key] > 1:
        del _TRIED[key]
        return False
    return True


def search_page(fragment: str, cursor: str | None) -> Response:
    """Three pages of two nodes of a star range; the middle page fails once, and ranges from 5,000 on are refused."""
    low, page = int(re.search(r"\d+", fragment)[0]), int(cursor or 0)
    if low >= 5000:
        return Response(200, {"errors": ["range refused"]})
    if page == 1 and first_try((fragment, cursor)):
        return Response(502)
    nodes = [json.dumps({"id": f"s{low}-{page}-{k}", "nameWithOwner": f"o/n{low}", "stargazerCount": low}) for k in range(2)]
    return Response(200, {"nodes": nodes, "next": str(page + 1) if page < 2 else None})


def readme(name: str) -> Response:
    """By the record's number n: gone, blank, large (by address), refused, or its own name in base64 after a network error."""
    n = int(name.rsplit("-", 1)[1])
    if n % 11 == 0:
        return Response(404 if n % 2 else 451)
    if n % 11 == 1:
        return Response(200, {"encoding": "base64", "content": base64.b64encode(b" \n\t").decode()})
    if n % 11 == 2:
        return Response(200, {"content": "", "download_url": f"raw/{n}"})
    if n % 11 == 3:
        return Response(403, "no access")
    if n % 11 == 4 and first_try(name):
        raise ConnectionError("reset")
    return Response(200, {"encoding": "base64", "content": base64.b64encode(f"  # {name}\n".encode()).decode()})


def raw_readme(url: str) -> Response:
    return Response(200, b"large " * 60_000) if int(url.split("/")[1]) % 2 else Response(404)


def projects(payload: dict) -> Response:
    """Knows every project but those of owners whose number is 3; answers two requests a page."""
    asked, at = payload["requests"], int(payload.get("pageToken", 0))
    responses = []
    for item in asked[at : at + 500]:
        key = item["projectKey"]["id"]
        known = not key.startswith("github.com/src3/")
        responses.append({"request": item} | ({"project": {"projectKey": {"id": key.upper()}, "starsCount": len(key)}} if known else {}))
    more = {"nextPageToken": str(at + 500)} if at + 500 < len(asked) else {}
    return Response(200, {"responses": responses} | more)


def dependents(path: str) -> Response:
    """Dependents of a version: as many as its path is long; packages whose name ends in ``bolt`` are unknown."""
    return Response(404) if "bolt/" in path else Response(200, {"dependentCount": len(path)})


class ServiceError(Exception):
    """The embedding service gave out."""
