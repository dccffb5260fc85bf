"""URLs as browsers read them: parts, resolution against a base, and the host in its one form. Plain Python."""

from __future__ import annotations

import ipaddress
import re
from typing import NamedTuple
from urllib.parse import quote, quote_plus, unquote_plus, unquote_to_bytes

PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_PORT = re.compile(r":([0-9]*)$")
# Characters that stay as they are in each part, and those that no host has.
_USER, _PATH, _QUERY, _HASH = "!$&'()*+,-.%~", "!$&'()*+,-./:;=@[]|%~\\", "!$&()*+,-./:;=?@[\\]^`{|}%~", "!$&'()*+,-./:;=?@[\\]^{|}%~#"
_BAD_HOST = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")
_TRACKING = re.compile(r"(?i)^(?:utm_|fbclid$|gclid$)")


class Url(NamedTuple):
    scheme: str
    user: str
    password: str
    host: str
    port: str
    path: str
    query: str | None
    hash: str | None

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}" + (f":{self.port}" if self.port else "")

    def href(self) -> str:
        who = self.user + (f":{self.password}" if self.password else "") + "@" if self.user or self.password else ""
        tail = ("" if self.query is None else "?" + self.query) + ("" if self.hash is None else "#" + self.hash)
        return f"{self.scheme}://{who}{self.host}" + (f":{self.port}" if self.port else "") + self.path + tail


def ipv4(host: str) -> ipaddress.IPv4Address | None:
    """The address of a host that ends in a number, in decimal, octal or hexadecimal parts; ValueError for a broken one, None for a name."""
    parts = host.split(".")
    if len(parts) > 1 and not parts[-1]:
        parts.pop()
    if not re.fullmatch(r"[0-9]+|0[xX][0-9A-Fa-f]*", parts[-1]):
        return None
    if len(parts) > 4:
        raise ValueError(host)
    numbers = []
    for p in parts:
        if p[:2].lower() == "0x":
            numbers.append(int(p[2:] or "0", 16))
        elif re.fullmatch(r"0[0-7]+|[0-9]|[1-9][0-9]*", p):
            numbers.append(int(p, 8 if len(p) > 1 and p[0] == "0" else 10))
        else:
            raise ValueError(host)
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise ValueError(host)
    return ipaddress.IPv4Address(sum(n * 256 ** (3 - i) for i, n in enumerate(numbers[:-1])) + numbers[-1])


def host_of(text: str) -> str:
    """A host in its one form: lower case, ASCII, addresses in full; ValueError where there is none."""
    if text.startswith("["):
        if not text.endswith("]") or "%" in text:
            raise ValueError(text)
        return f"[{ipaddress.IPv6Address(text[1:-1]).compressed}]"
    name = unquote_to_bytes(text).decode("utf-8")
    if not name.isascii():
        name = name.replace("。", ".").encode("idna").decode("ascii")
    name = name.lower()
    if not name or _BAD_HOST.search(name):
        raise ValueError(text)
    number = ipv4(name)
    return str(number) if number is not None else name


def _path(text: str, base: list[str]) -> str:
    """A path without dot segments, behind the segments of ``base``."""
    out = list(base)
    segments = text.replace("\\", "/").split("/")
    for i, s in enumerate(segments):
        last = i == len(segments) - 1
        plain = s.lower().replace("%2e", ".")
        if plain == "..":
            out = out[:-1]
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(quote(s, safe=_PATH))
    return "/" + "/".join(out)


def parse(text: str, base: str | None = None) -> Url:
    """The parts of a web URL, or of a reference against ``base``; ValueError for anything else."""
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    m = _SCHEME.match(text)
    known = parse(base) if base else None
    rest, mark, tail = text.partition("#")
    hash_ = quote(tail, safe=_HASH) if mark else None
    if m and m[1].lower() in PORTS:
        scheme, rest = m[1].lower(), rest[m.end() :]
        if known and known.scheme == scheme and not re.match(r"[/\\]{2}", rest):
            m = None
        else:
            rest = rest.lstrip("/\\")
    elif m:
        raise ValueError(text)
    elif not known:
        raise ValueError(text)
    elif re.match(r"[/\\]{2}", rest):
        scheme, rest, m = known.scheme, rest.lstrip("/\\"), True
    rest, mark, tail = rest.partition("?")
    query = quote(tail, safe=_QUERY) if mark else None
    if not m:
        if not rest:
            return known._replace(query=known.query if query is None else query, hash=hash_)
        own = [] if rest[0] in "/\\" else known.path[1:].split("/")[:-1]
        return known._replace(path=_path(rest[1:] if rest[0] in "/\\" else rest, own), query=query, hash=hash_)
    cut = re.search(r"[/\\]", rest)
    where, path = (rest[: cut.start()], rest[cut.start() + 1 :]) if cut else (rest, "")
    who, at, where = where.rpartition("@")
    user, _, password = who.partition(":")
    port = _PORT.search(where) if not where.endswith("]") else None
    number = port[1].lstrip("0") or ("0" if port and port[1] else "") if port else ""
    if number and int(number) > 65535:
        raise ValueError(text)
    host = host_of(where[: port.start()] if port else where)
    return Url(scheme, quote(user, safe=_USER), quote(password, safe=_USER), host, "" if number == PORTS[scheme] else number, _path(path, []), query, hash_)


def pairs(query: str | None) -> list[tuple[str, str]]:
    """The names and values of a query."""
    out = []
    for p in (query or "").split("&"):
        if p:
            k, _, v = p.partition("=")
            out.append((unquote_plus(k, errors="replace"), unquote_plus(v, errors="replace")))
    return out


def encoded(of: list[tuple[str, str]]) -> str:
    part = lambda s: quote_plus(s, safe="*-._").replace("~", "%7E")
    return "&".join(f"{part(k)}={part(v)}" for k, v in of)


def resolve(reference: str, base: str) -> str | None:
    """The web address that a link of a page leads to; None for other schemes and what is no URL."""
    try:
        u = parse(reference, base)
    except ValueError:
        return None
    return u.href() if u.scheme in ("http", "https") else None


def canonical(text: str, base: str | None = None) -> str:
    """The one form of a page's URL: no fragment, no tracking, parameters sorted by name; ValueError for other schemes and credentials."""
    u = parse(text, base)
    if u.scheme not in ("http", "https") or u.user or u.password:
        raise ValueError("only http and https URLs without credentials")
    kept = sorted((p for p in pairs(u.query) if not _TRACKING.match(p[0])), key=lambda p: p[0].encode("utf-16-be"))
    return u._replace(query=encoded(kept) or None, hash=None).href()


# Addresses that no public service has.
_CLOSED = [ipaddress.ip_network(n) for n in """
0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.31.196.0/24 192.52.193.0/24 192.88.99.0/24 192.168.0.0/16
192.175.48.0/24 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4
::/128 ::1/128 fe80::/10 ff00::/8 fc00::/7 100::/64 ::ffff:0:0:0/96 64:ff9b::/96 2002::/16 2001::/32 2001:2::/48 2001:3::/32 2001:4:112::/48 2001:10::/28 2001:20::/28
2001:30::/28 2001:db8::/32 3fff::/20
""".split()]


def public_address(text: str) -> bool:
    """Whether an IP address is one of the public net; IPv6 forms of IPv4 addresses count as these."""
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return False
    a = getattr(a, "ipv4_mapped", None) or a
    return not any(a.version == n.version and a in n for n in _CLOSED)


def public_host(host: str | None) -> bool:
    """Whether a host, as it stands in a URL with or without user and port, may be fetched."""
    if not host:
        return False
    try:
        name = parse(f"http://{host}").host
    except ValueError:
        return False
    bare = name.strip("[]").rstrip(".") if not name.endswith("..") else ""
    if not bare or bare == "localhost" or bare.endswith((".localhost", ".local", ".internal")):
        return False
    try:
        ipaddress.ip_address(bare)
    except ValueError:
        return True
    return public_address(bare)


def target_allowed(url: str | None) -> bool:
    """Whether a URL may be fetched: http or https, no credentials, no local or private host."""
    try:
        u = parse(url or "")
    except ValueError:
        return False
    return u.scheme in ("http", "https") and not (u.user or u.password) and public_host(u.host)


_SENSITIVE = re.compile(r"(?i)^(?:access[_-]?token|refresh[_-]?token|api[_-]?key|auth(?:orization)?|token|password|passwd|secret|session(?:id)?|signature|sig|code|key|x-amz-.+|x-goog-.+)$")


def redacted_url(text: str) -> str:
    """A URL without credentials, fragment and secret values; what is no URL stays as it is."""
    try:
        u = parse(text)
    except ValueError:
        return text
    own = pairs(u.query)
    out, seen = [], set()
    for k, v in own:
        if not _SENSITIVE.match(k):
            out.append((k, v))
        elif k not in seen:
            seen.add(k)
            out.append((k, "[REDACTED]"))
    return u._replace(user="", password="", hash=None, query=encoded(out) if seen else u.query).href()
