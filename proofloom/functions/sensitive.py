"""What a text that leaves the system must not hold: one Column of matches for each family, put together from public formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALNUM = "0-9A-Za-z"
_WORD = "0-9A-Za-z_"
_HEX = "[0-9A-Fa-f]"
_BASE64URL = "[0-9A-Za-z_-]"

#: Directories under the root of the Filesystem Hierarchy Standard, and those that macOS adds.
ROOT_DIRECTORIES = "bin boot dev etc home lib media mnt opt proc root run sbin srv sys tmp usr var".split()
MAC_DIRECTORIES = "Applications Library System Users Volumes private".split()
#: Lengths in bits of the digests that are written in hexadecimal (SHA-1, SHA-256).
DIGEST_BITS = (160, 256)
#: Hexadecimal digits in the groups of a UUID (RFC 4122).
UUID_GROUPS = (8, 4, 4, 4, 12)
#: Bytes at least of a token's header ({"alg":"x"}), claims ({}) and signature (RFC 7519); the header begins with {".
JWT_BYTES = (11, 2, 2)
#: Characters of file names on Windows.
_NAME = r"[^\s<>:\"|?*/\\]"
#: Documented prefixes of keys, the characters that follow, and how many at least.
KEY_FORMS = [
    (("AKIA", "ASIA"), "[0-9A-Z]", 16),
    (("AIza",), _BASE64URL, 30),
    (("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), "[0-9A-Za-z_]", 20),
    (("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), "[0-9A-Za-z-]", 10),
    (("sk-", "rk-", "pk-", "sk_live_", "rk_live_", "pk_live_"), _BASE64URL, 16),
]
#: Characters of a local part's atoms (RFC 5322), and of user information in an address (RFC 3986) but for the colon.
_ATOM = r"[0-9A-Za-z!#$%&'*+/=?^_`{|}~-]+"
_USER = r"[0-9A-Za-z._~!$&'()*+,;=%-]"
#: Characters of an address (RFC 3986: unreserved, reserved and the percent sign).
_URI = r"[0-9A-Za-z._~:/?#\[\]@!$&'()*+,;=%-]"


def _apart(body: str, beside: str = _WORD) -> str:
    """Not within a longer word; a look at what stands beside takes nothing from the next match."""
    return f"(?<![{beside}])(?:{body})(?![{beside}])"


def _any(parts) -> str:
    return "(?:" + "|".join(parts) + ")"


def _pattern(pattern: str) -> Callable[[Column], Column]:
    return lambda text: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _addresses(text: Column) -> Column:
    """Dotted quads of numbers up to 255 that are no part of a longer row of numbers."""
    number = "[0-9]{1,3}"
    quads = F.regexp_extract_all(text, F.lit(rf"(?<![{_WORD}.]){number}(?:\.{number}){{3}}(?![{_WORD}]|\.[{_WORD}])"), F.lit(0))
    return F.filter(quads, lambda q: F.forall(F.split(q, r"\."), lambda n: n.cast("int") <= 255))


def _below(directories: list[str]) -> Callable[[Column], Column]:
    return _pattern(rf"(?<![{_ALNUM}])/{_any(directories)}/")


FAMILIES: dict[str, Callable[[Column], Column]] = {
    "windows_path": _pattern(rf"(?<![{_ALNUM}])[A-Za-z]:[/\\]+{_NAME}"),
    "windows_unc_path": _pattern(rf"(?<![{_ALNUM}])\\\\{_NAME}+\\"),
    "unix_path": _below(ROOT_DIRECTORIES),
    "macos_path": _below(MAC_DIRECTORIES),
    "private_key": _pattern("-----BEGIN (?:[0-9A-Z]+ )*PRIVATE KEY-----"),
    "jwt": _pattern(_apart("(?=eyJ)" + r"\.".join(f"{_BASE64URL}{{{(8 * n + 5) // 6},}}" for n in JWT_BYTES))),
    "api_key_or_token": _pattern(_apart(_any(f"{_any(prefixes)}{kind}{{{least},}}" for prefixes, kind, least in KEY_FORMS))),
    "credentials_in_url": _pattern(rf"(?<![{_WORD}])[A-Za-z][0-9A-Za-z+.-]*://{_USER}+:{_USER}+@"),
    "uuid": _pattern(_apart("-".join(f"{_HEX}{{{n}}}" for n in UUID_GROUPS))),
    "hex_digest": _pattern(_apart(_any(f"{_HEX}{{{bits // 4}}}" for bits in DIGEST_BITS))),
    "email_address": _pattern(rf"{_ATOM}(?:\.{_ATOM})*@(?:[0-9A-Za-z-]+\.)+[A-Za-z]{{2,}}(?![{_WORD}])"),
    "ip_address": _addresses,
}


def addresses(text: Column) -> Column:
    """Web addresses of a text."""
    return F.regexp_extract_all(text, F.lit(rf"(?<![{_WORD}])(?i:https?)://{_URI}+"), F.lit(0))


def host_of(address: Column) -> Column:
    """Host of an address, in lower case."""
    authority = F.regexp_extract(address, r"^[^:]+://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))
