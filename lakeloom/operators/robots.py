"""Rules of robots.txt: the longest rule that matches a path decides, of equally long ones the one that allows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from lakeloom.functions import whatwg

AGENT = "lakeloom"


class RobotsError(RuntimeError):
    """The rules could not be had, so nothing may be fetched."""


@dataclass
class Robots:
    rules: list[tuple[str, bool]] = field(default_factory=list)
    delay: float | None = None

    def allowed(self, url: str) -> bool:
        u = whatwg.parse(url)
        path = u.path + ("" if u.query is None else "?" + u.query)
        best = (-1, True)
        for rule, allow in self.rules:
            if _matches(rule, path):
                best = max(best, (len(rule), allow))
        return best[1]


def _matches(rule: str, path: str) -> bool:
    end = rule.endswith("$")
    parts = [re.escape(p) for p in (rule[:-1] if end else rule).split("*")]
    return re.match(".*?".join(parts) + ("$" if end else ""), path) is not None


def parse_robots(text: str, agent: str = AGENT) -> Robots:
    """The rules for ``agent``: those of its own groups, else of the groups for everyone."""
    groups: dict[str, Robots] = {}
    names: list[str] = []
    fresh = False
    for line in text.lstrip("﻿").splitlines():
        key, mark, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not mark:
            continue
        if key == "user-agent":
            names = names if fresh else []
            names.append(value.lower())
            groups.setdefault(value.lower(), Robots())
            fresh = True
            continue
        if key in ("allow", "disallow", "crawl-delay"):
            fresh = False
            for n in names:
                if key == "crawl-delay":
                    if re.fullmatch(r"[0-9]+(?:\.[0-9]+)?", value):
                        groups[n].delay = float(value)
                elif value:
                    groups[n].rules.append((value, key == "allow"))
    own = [r for n, r in groups.items() if n != "*" and n and n in agent.lower()]
    found = own or [groups[n] for n in ("*",) if n in groups]
    return Robots([x for r in found for x in r.rules], next((r.delay for r in found if r.delay is not None), None))


def robots_of(status: int, text: str, agent: str = AGENT) -> Robots:
    """The rules that an answer for /robots.txt gives: none where there is no such file; RobotsError where it is refused or fails."""
    if status in (401, 403):
        raise RobotsError("robots.txt access denied; crawl stopped")
    if status >= 500 or status == 429:
        raise RobotsError("robots.txt unavailable; retry later")
    return parse_robots(text, agent) if status == 200 else Robots()
