"""Credentials embedded in source code and configuration: found, and redacted in place.

Literals near assignments, headers, addresses, commands and remarks are segmented by Viterbi into
words of a dictionary that the corpus' own symbols, calls and code give. What no word explains is
the residual, and the residual decides on every candidate: how much of it a secret needs depends
on the context, less after the beginning of a known token, little for a password, most of the
body for a private key. Placeholders (made of words that say so, or of three different characters
at most), references, hashes, ids, public keys, certificates and messages about a password are
excluded. No candidate is lost for its length or for the length of the name before it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import spread

#: Words of the dictionary at most (by number of uses); the bound of what is sent to the tasks.
DICTIONARY_WORDS = 20_000
#: Words rarer than this are left out: chance repetitions inside random values are no words.
LEAST_SHARE = 1e-6
#: By context the characters that no word may explain, and their share of the value, from which it is a credential.
LEAST_RESIDUAL = {"known": (4, 0.2), "secret": (8, 0.4), "password": (4, 0.0), "password with digits": (1, 0.0), "pem": (16, 0.5)}

# Last words of names that hold passwords, other secrets, and what only looks so.
PASSWORD_NAMES = {"password", "passwd", "passphrase", "pass", "pwd", "pw", "passcode", "pin"}
SECRET_NAMES = {"secret", "token", "key", "apikey", "cred", "creds", "credential", "credentials", "auth", "authorization", "bearer", "tok", "login"}
HASH_NAMES = {"hash", "sha", "sha1", "sha256", "sha512", "md5", "digest", "checksum", "etag", "revision", "commit", "fingerprint", "public", "pub"}
# Beginnings of known tokens.
_KNOWN = r"AKIA[0-9A-Z]{16}\b|ASIA[0-9A-Z]{16}\b|xox[a-z]-[\w-]{10,}|sk[-_](?:live_|test_|proj-)?[A-Za-z0-9_-]{16,}|[a-z]{2,5}_live_[A-Za-z0-9]{12,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}|gh[pousr]_\w{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|AIza[\w-]{30,}|npm_\w{30,}"
_NAMES = "password|passwd|passphrase|passcode|pass|pwd|pw|secret|token|apikey|key|credentials?|creds?|authorization|auth|bearer|tok|login"
_PLACEHOLDER = re.compile(r"(?i)\$\{|\{\{|^\{.*\}$|^<.*>$|^\$\(?\w|^%\w|%\(|^\[.*\]$|\.\.\.|…|<[\w -]+>|x{4,}|\*{3,}|(?:^|[^0-9a-z])0{8,}")
# Words of which placeholders are made.
PLACEHOLDER_WORDS = set(
    "a an any actual added api app be before bar changeme change client demo docs dummy empty enter example fake false fill foo for from goes here hidden in insert is it key me missing mock my new no none not null of or passphrase passwd password placeholder please put real redacted removed replace replaceme sample secret set some tbd test testing that the this to todo token true use user value with you your".split()
)
# Words of messages; a text with spaces that has two of them, or names a credential, isn't a passphrase.
_MESSAGE = re.compile(rf"(?i)\b(?:{_NAMES})s?\b|\b(?:a|an|and|are|at|be|been|between|can|cannot|can't|contain|contains|did|do|does|empty|enter|for|from|has|have|if|in|invalid|is|it|least|missing|must|no|not|of|or|please|required|should|than|the|to|too|was|with|wrong|you|your)\b")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
_HASH = re.compile(r"(?i)^(?:sha\d+[:-]|md5[:-]|\$(?:2[aby]|argon2\w*|pbkdf2[\w-]*|[156])\$|\{(?:sha|ssha|bcrypt)\})")
_REFERENCE = re.compile(r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$|(?i:^(?:vault|env|file|secret|ssm|arn|op|kms|keyring)[:/])|^(?:/|\./|~/|\.\./)(?:[A-Za-z][\w.-]*/)*[\w.-]+$|^os\.|^\w+\(\)$|^[\w.-]+\.(?:pem|key|crt|txt|json|ya?ml|env|p12|jks)$")

# Where a credential may begin: cheap literals first, the patterns below only there.
_HINTS = re.compile(
    r"private key|akia|asia|xox|sk[-_]|_live_|eyj|gh[pousr]_|github_pat_|glpat-|aiza|npm_|://|pass|pwd|pw|secret|token|key|cred|auth|bearer|basic |tok|login|-u |-p"
    r"|(?:#|//) ?[a-z][a-z ]*+: ?(?=[^\s\"']{16,}(?:\r?\n|$))|(?:#|//) ?[a-z][\w .@:-]*? / (?=[^\s\"'/]{6,}[ \t]*(?:\r?\n|$))|[\"'][;,)]* {1,4}(?:#|//) "
)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KNOWN_AT = re.compile(rf"(?:{_KNOWN})")
_USER = re.compile(r"://[^\s:/@\"'`{}<>]*:(?=[^\s\"'`@]+@[\w\[])")
_HEAD = re.compile(r"(?:Bearer|Basic|(?<=Authorization: )Token) +(?=[\w+/=.~-]{8,})", re.I)
_FLAG = re.compile(r"(?:(?<=[\s\"'])--?(?:password|passwd|pass|token|secret|api-key)(?:=| +)|(?<=\s)-u +[\w.-]+:|(?<=\s)-p(?=[^\s-]))[\"']?", re.I)
_NAMED = re.compile(
    rf"""(?:{_NAMES})(?:_?\d{{1,3}})?(?:["'\]]+\)?)?[\ \t]*(?::[\ \t]*[A-Za-z_][\w\[\].|,\ \t]*+(?==))?(?:===?|!=|:=|=>|=|:|,|\.equals(?:IgnoreCase)?\()[\ \t]*""", re.X | re.I
)
# Words of a comment that mark the literal before it, and labels of comments that don't.
_REMARK = re.compile(r"(?i)\b(?:keys?|tokens?|accounts?|share|secret|password|credentials?|login|private|rotate|prod|production|staging|temporary|remove)\b")
_COMMENT = re.compile(r"(?:#|//) ?([A-Za-z][A-Za-z ]*+): ?(?=[^\s\"']{16,}(?:\r?\n|$))")
_LOGIN = re.compile(r"(?:#|//) ?([A-Za-z][\w .@:-]*?) / (?=[^\s\"'/]{6,}[ \t]*(?:\r?\n|$))")
_NO_LABEL = re.compile(r"(?i)\b(?:see|sha\d*|md5|hash|checksum|digest|commit|revision|etag|url|link|source|ticket|id|uuid|file|path|noqa|type)\b")
_NAME_END = re.compile(_NAMES, re.I)
_BODY = re.compile(r"(?:\\n|[\"'\s+\\rn]|\r?\n|[ \t*#])*((?:[A-Za-z0-9+/=:, -]{16,}(?:\\n|[\"'\s+\\]|\r?\n)*)+)")
_VALUES = {"user": re.compile(r"[^\s\"'`]*(?=@)"), "query": re.compile(r"[^\s\"'`&;,]+"), "head": re.compile(r"[\w+/=.~-]+"), "flag": re.compile(r"[^\s\"'`]+"), "comment": re.compile(r"\S+"), "remembered": re.compile(r"\S+")}
_OPENED = re.compile(r"\([ \t]*\\?\r?\n?[ \t]*(?=[rRbBuU]{0,2}[\"'])")
_BARE = re.compile(r"[^\s\"'`,;]+")
_STRING = re.compile(r"[rRbBuUfF]{0,2}(\"\"\"|'''|\"|')")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_NEXT_PIECE = re.compile(r"[ \t]*\\?\r?\n?[ \t]*(?:\+[ \t]*)?\\?\r?\n?[ \t]*(?:\+[ \t]*)?[rRbBuU]{0,2}([\"'])")


class Dictionary:
    """Unigram model over words; a character that no word explains costs more than any word's share."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=0)
        self.unknown = 4.5

    def residual(self, text: str) -> int:
        """Characters of letter and digit runs outside the words of the cheapest segmentation.

        Digits are never explained by words; runs of up to four digits at the end of a word count little.
        """
        rest = 0
        for run in re.findall(r"[A-Za-z0-9]+", text):
            low, n = run.lower(), len(run)
            best, left = [0.0] + [math.inf] * n, [0] * (n + 1)
            for i in range(n):
                if best[i] + self.unknown < best[i + 1]:
                    best[i + 1], left[i + 1] = best[i] + self.unknown, left[i] + 1
                for j in range(i + 3, min(n, i + self.longest) + 1):
                    cost = self.cost.get(low[i:j])
                    if cost is not None and best[i] + cost < best[j]:
                        best[j], left[j] = best[i] + cost, left[i]
            rest += left[n]
        return rest


def _is_placeholder(value: str) -> bool:
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", value)]
    only_words = bool(words) and not re.search(r"\d{3}", value) and all(w in PLACEHOLDER_WORDS for w in words)
    return only_words or bool(_PLACEHOLDER.search(value)) or len(set(value)) <= 3 or bool(_REFERENCE.search(value))


def _name_start(code: str, at: int) -> int:
    """Where the name that goes on at `at` begins."""
    while at and (code[at - 1].isalnum() or code[at - 1] in "_.-"):
        at -= 1
    return at


def _line_start(code: str, at: int) -> int:
    return code.rfind("\n", 0, at) + 1


def _name_kind(name: str) -> str:
    """password, secret or nothing, from the last words of a name."""
    words = [w.lower() for w in _PARTS.findall(name) if not w.isdigit()]
    if not words or any(w in HASH_NAMES for w in words[-2:-1] if words[-1] == "key") or words[-1] in HASH_NAMES:
        return ""
    if words[-1] in PASSWORD_NAMES:
        return "password"
    return "secret" if words[-1] in SECRET_NAMES or words[-2:] == ["api", "key"] else ""


def _is_message(text: str) -> bool:
    said = [m[0] for m in _MESSAGE.finditer(text)]
    return " " in text and (len(said) > 1 or any(_NAME_END.fullmatch(w.rstrip("sS")) or _NAME_END.fullmatch(w) for w in said))


def _accept(kind: str, value: str, words: Dictionary) -> bool:
    value = value.strip()
    if not value or (kind != "password" and " " in value) or _is_message(value) or _is_placeholder(value) or _UUID.match(value) or _HASH.match(value):
        return False
    if kind != "known" and (value.startswith(("http://", "https://", "data:", "ssh-")) or re.fullmatch(r"[\d.,:x/ -]+", value)):
        return False
    rest = words.residual(value)
    if kind == "password" and re.search(r"\d", value):
        if re.fullmatch(r"[\w.-]+(?:/[\w.-]+)+", value) and rest < LEAST_RESIDUAL["secret"][0]:
            return False  # a path of words
        kind = "password with digits"
    least, share = LEAST_RESIDUAL[kind]
    return rest >= least and rest >= share * len(value)


def _pieces(code: str, at: int, configuration: bool) -> list[tuple[int, int]]:
    """Spans of the literal that begins at `at`, with its continuation pieces; or of the bare value of a configuration."""
    m = _STRING.match(code, at)
    if m is None:
        opened = _OPENED.match(code, at)
        if opened:
            return _pieces(code, opened.end(), configuration)
        if not configuration:
            return []
        bare = _BARE.match(code, at)
        return [bare.span()] if bare else []
    spans, quote = [], m[1]
    while m is not None:
        quote, start = m[1], m.end()
        end = start
        while end < len(code) and not code.startswith(quote, end):
            if len(quote) == 1 and code[end] == "\n":
                return spans
            end += 2 if code[end] == "\\" and end + 1 < len(code) else 1
        if end >= len(code):
            return spans + [(start, end)] if len(quote) == 3 else spans
        spans.append((start, end))
        after = _NEXT_PIECE.match(code, end + len(quote))
        m = _STRING.match(code, after.end() - 1) if after and len(quote) == 1 else None
    return spans


def _at(code: str, hint: str, at: int) -> tuple[str, int, int] | None:
    """Kind of the candidate at a hint, where it begins and where its value does."""
    if hint == "private key":
        start = code.rfind("-----BEGIN", _line_start(code, at), at)
        m = _PEM.match(code, start) if start >= 0 else None
        return ("pem", start, m.end()) if m else None
    if hint == "://":
        return ("user", at, m.end()) if (m := _USER.match(code, at)) else None
    if hint[0] in "#/":
        kind, m = ("comment", _COMMENT.match(code, at)) if not hint.endswith(" / ") else ("remembered", _LOGIN.match(code, at))
        return (kind, at, m.end()) if m and not _NO_LABEL.search(m[1]) else None
    if hint[0] in "\"'":
        start = code.rfind(hint[0], code.rfind("\n", 0, at) + 1, at)
        line_end = code.find("\n", at)
        remark = code[at + len(hint) : line_end if line_end >= 0 else len(code)]
        return ("remarked", start, start + 1) if start >= 0 and _REMARK.search(remark) else None
    if hint in ("bearer", "basic ", "token") and (m := _HEAD.match(code, at)):
        return ("head", at, m.end())
    if hint == "_live_":
        start = len(code[:at].rstrip("abcdefghijklmnopqrstuvwxyz")) if at < 8 else at - len(code[at - 8 : at]) + len(code[at - 8 : at].rstrip("abcdefghijklmnopqrstuvwxyz"))
    else:
        start = at
    if (start == 0 or not (code[start - 1].isalnum() or code[start - 1] in "_/+")) and (m := _KNOWN_AT.match(code, start)):
        return ("known", start, start)
    if code[at - 1 : at] == "-" or hint.startswith("-"):
        for back in (at, at - 1, at - 2):
            if back >= 0 and (m := _FLAG.match(code, back)):
                return ("flag", back, m.end())
    if m := _NAMED.match(code, at):
        name_start = _name_start(code, at)
        if code[name_start - 1 : name_start] in ("?", "&", ";") and code[m.end() - 1 : m.end()] == "=" and name_start:
            return ("query", name_start, m.end())
        return ("named", at, m.end())
    return None


def _accept_body(body: str, words: Dictionary) -> bool:
    """Whether what follows a BEGIN line is the body of a key: long runs that words don't explain."""
    runs = re.findall(r"[A-Za-z0-9+/=]{16,}", body)
    least, share = LEAST_RESIDUAL["pem"]
    return any(words.residual(run) >= max(least, share * len(run)) for run in runs if len(run) >= 24)


def _judge(code: str, kind: str, at: int, value_at: int, configuration: bool, words: Dictionary) -> list[tuple[int, int]]:
    """Spans of the credential of a candidate; none if it isn't one."""
    if kind == "pem":
        body = _BODY.match(code, value_at)
        if not body or not _accept_body(body[1], words):
            return []
        return [(at, value_at)] + [(body.start(1) + x.start(), body.start(1) + x.end()) for x in re.finditer(r"[A-Za-z0-9+/=]{16,}", body[1])]
    if kind == "known":
        spans = _pieces(code, at - 1, False) if at and code[at - 1] in "\"'" else []
        if len(spans) < 2:
            spans = [_KNOWN_AT.match(code, at).span()]
        before = code[_line_start(code, at) : at].split()
        blob = bool(before) and code[at - 1] not in " \t" and "base64," in before[-1].lower() or any(w.startswith("ssh-") or "\"ssh-" in w for w in before[-2:])
        fine = not blob and _accept("known", "".join(code[a:b] for a, b in spans), words)
        return spans if fine else []
    if kind == "named":
        name_end = _NAME_END.match(code, at).end()
        as_kind = _name_kind(code[_name_start(code, at) : name_end])
        spans = _pieces(code, value_at, configuration) if as_kind else []
        value = "".join(code[a:b] for a, b in spans)
        return spans if spans and "://" not in value and _accept(as_kind, value, words) else []
    if kind == "remarked":
        end = code.find(code[at], value_at)
        name = re.search(r"([\w.]*)[\"'\]]*\s*(?:=|:)\s*$", code[_line_start(code, at) : at])
        value = code[value_at:end]
        fine = name and not (set(w.lower() for w in _PARTS.findall(name[1])[-1:]) & HASH_NAMES) and len(value) >= 16 and _accept("secret", value, words)
        return [(value_at, end)] if fine else []
    stop = _VALUES[kind].match(code, value_at)
    if not stop:
        return []
    if code[at:value_at] == "-p" and re.fullmatch(r"[a-z]{1,5}", stop[0]):
        return []  # an option such as -path, or a line that a patch removes
    as_kind = "password" if kind in ("user", "flag", "remembered") or _name_kind(code[at:value_at].rstrip("=")) == "password" else "secret"
    return [stop.span()] if _accept(as_kind, stop[0], words) else []


def find_secrets(code: str, configuration: bool, words: Dictionary) -> list[list[tuple[int, int]]]:
    """Of each credential the spans (start, end) of its pieces in `code`, in order of their starts."""
    low = code.lower()
    if len(low) != len(code):  # a few letters change their length
        low = "".join(c.lower() if c.isascii() else c for c in code)
    found, taken = [], 0
    for m in _HINTS.finditer(low):
        if m.start() < taken:
            continue
        candidate = _at(code, m[0], m.start())
        if candidate and candidate[1] >= taken and (spans := _judge(code, *candidate, configuration, words)):
            found.append(spans)
            taken = spans[-1][1]
    return found


def redact(code: str, secrets: list[list[tuple[int, int]]], mark: str = "REDACTED") -> str:
    """`code` with every piece of every credential replaced; BEGIN lines of keys stay, nothing else changes."""
    out, at = [], 0
    for a, b in sorted(span for spans in secrets for span in spans):
        if code.startswith("-----BEGIN", a):
            continue
        out += [code[at:a], mark]
        at = b
    return "".join([*out, code[at:]])


def dictionary(chunks: DataFrame, most: int = DICTIONARY_WORDS) -> dict[str, int]:
    """The words of all symbols, calls and codes with their number of uses, the `most` frequent of them.

    Words have three letters or more and at least `LEAST_SHARE` of all uses.
    """
    names = F.concat_ws(" ", "symbol", "calls", "code")
    parts = chunks.select(F.explode(F.regexp_extract_all(names, F.lit("[A-Z]?[a-z]{2,}"), F.lit(0))).alias("word"))
    counted = parts.groupBy(F.lower("word").alias("word")).count().where("count > 1 and length(word) > 2")
    total = F.sum("count").over(Window.partitionBy())
    best = counted.orderBy(F.desc("count"), "word").limit(most)  # a bounded table, so its total is one small task
    return {r["word"]: r["count"] for r in best.withColumn("total", total).where(F.col("count") >= LEAST_SHARE * F.col("total")).collect()}


def embedded_credentials(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """`key`, line_nos (array of 1-based lines on which a credential starts) and redacted (code) of the chunks with credentials.

    Null and empty codes, and rows without key, have none; a null file counts as configuration.
    Repeated rows come out repeatedly, in any case alike. An empty table gives an empty result, and
    further columns are ignored.
    """
    kind = chunks.schema[key].dataType.simpleString()
    counts = dictionary(chunks)
    rows = chunks.where(F.col(key).isNotNull() & (F.length("code") > 0)).select(F.col(key).alias("__key"), "code", (~F.coalesce(F.lower("file").rlike(r"\.(py|java|kt|js|ts|go|c|cc|cpp|rs|scala)$"), F.lit(False))).alias("bare"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Dictionary(counts)
        for batch in batches:
            keys, lines, codes = [], [], []
            for k, code, bare in zip(*(batch.column(c).to_pylist() for c in ("__key", "code", "bare"))):
                if secrets := find_secrets(code, bare, words):
                    keys.append(k)
                    lines.append(sorted({code.count("\n", 0, s[0][0]) + 1 for s in secrets}))
                    codes.append(redact(code, secrets))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("__key").type), pa.array(lines, pa.list_(pa.int64())), pa.array(codes, pa.string())], names=["__key", "line_nos", "redacted"])

    return spread(rows).mapInArrow(run, f"__key {kind}, line_nos array<bigint>, redacted string").withColumnRenamed("__key", key)
