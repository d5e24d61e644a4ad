"""Secret scans: fixed patterns, and novelty against a dictionary-primed zstandard compressor.

Base kinds are three patterns. Beyond them each token of SHORTEST characters or more with a sensitive word on either
side, over line breaks, is a candidate, and the body of a private key between its BEGIN and END lines is secret as a
whole. A candidate's marginal compressed bytes are the compressed size of the surrounding code followed by it, less that
of the code alone, under a compressor primed with a dictionary that zstandard trains on code: the sources of a fixed list
of Python's own modules, with their identifiers and the letter frequencies of names and words. Names, words and repeated
strings cost few bytes a character, keys and passwords cost nearly their entropy; novelty alone decides, whatever kinds
of characters a candidate has. Copies of the candidate itself are left out of the surroundings, so that a key that is
set and then used is novel both times. The dictionary is trained once, on the driver, and sent with the tasks (32 KB).

Null and empty texts have no spans. Each row is scanned alone, whole, whatever its length, so repeated rows have equal
spans; spans that start together come in the order of KINDS.
"""

from __future__ import annotations

import hashlib
import importlib
import inspect
import re
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, fresh, read_table, tuned, whole

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
#: Runs of hex digits are maximal, so a run starts where no hex digit stands before.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Characters of the shortest candidate.
SHORTEST = 16
LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
SENSITIVE = re.compile(r"passw|pwd|secret|token|key|auth|bearer|credential|private|cookie|session|signature", re.I | re.A)
#: Borders of a private key, and lines that may belong to one whose END is missing.
HEADER = re.compile(r"-----BEGIN (?![A-Z0-9 ]*PUBLIC)[A-Z0-9 ]*KEY(?: BLOCK)?-----")
FOOTER = re.compile(r"-----END [A-Z0-9 ]*KEY(?: BLOCK)?-----")
BODY = re.compile(r"(?:(?:\s|\\[nr])*(?:[A-Za-z0-9+/=]{20,}|[A-Za-z-]+:\x20[^\n]*))*(?:(?:\s|\\[nr])*[A-Za-z0-9+/]+={1,2}(?![A-Za-z0-9]))?")
#: Characters on each side of a candidate that make its context, over line breaks, and those that prime the compressor.
CONTEXT, AROUND = 48, 256
#: Least marginal bytes a character.
NOVELTY = 0.75
#: Python modules whose sources are the code that the dictionary is trained on, characters of a sample, and its bytes.
CODE = """json.decoder json.encoder http.client http.cookies configparser logging.config argparse email.message urllib.request
urllib.parse csv shelve ssl smtplib imaplib ftplib secrets hmac getpass netrc base64 uuid pathlib shutil subprocess threading
socket socketserver asyncio.streams xml.dom.minidom calendar gettext locale optparse tarfile zipfile textwrap datetime
decimal statistics""".split()
SAMPLE, DICTIONARY = 400, 1 << 15

SPANS = T.StructType([T.StructField("kind", T.ArrayType(T.StringType())), T.StructField("begin", T.ArrayType(T.IntegerType())), T.StructField("stop", T.ArrayType(T.IntegerType()))])


@lru_cache(maxsize=2)
def novelty_of(dictionary: bytes) -> Novelty:
    """One compressor per worker."""
    return Novelty(dictionary)


@lru_cache(maxsize=1)
def trained() -> bytes:
    """The dictionary; the same sources give the same bytes."""
    code = "\n".join(inspect.getsource(importlib.import_module(m)) for m in CODE)
    samples = [code[i : i + SAMPLE].encode() for i in range(0, len(code), SAMPLE)]
    return zstandard.train_dictionary(DICTIONARY, samples, level=3).as_bytes()


class Novelty:
    """Marginal compressed bytes of strings in their surroundings."""

    def __init__(self, dictionary: bytes | None = None, level: int = 3):
        primer = zstandard.ZstdCompressionDict(trained() if dictionary is None else dictionary)
        params = zstandard.ZstdCompressionParameters.from_level(level, write_checksum=0, write_content_size=0, write_dict_id=0)
        primer.precompute_compress(compression_params=params)
        self.compressor = zstandard.ZstdCompressor(dict_data=primer, compression_params=params)

    def marginal(self, around: bytes, candidate: bytes) -> int:
        return len(self.compressor.compress(around + candidate)) - len(self.compressor.compress(around))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of the fixed patterns, in code points."""
    found = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def key_blocks(text: str) -> list[tuple[int, int, int]]:
    """What stands between the BEGIN and END lines of private keys, whole: each line of it is secret."""
    if "KEY" not in text or "-----BEGIN" not in text:
        return []
    found = []
    for m in HEADER.finditer(text):
        again = HEADER.search(text, m.end())
        end = FOOTER.search(text, m.end(), again.start() if again else len(text))
        if end:
            stop = end.start()
        else:  # the END line is missing: as far as the lines look like a key's
            stop = BODY.match(text, m.end()).end()
        body = text[m.end() : stop]
        if body.strip():
            found.append((m.end() + len(body) - len(body.lstrip()), 3, m.end() + len(body.rstrip())))
    return found


def without(text: str, low: int, high: int, part: str) -> str:
    """text[low:high] less what belongs to copies of a part, those cut by the borders as well."""
    kept, at, last = [], low, high + len(part) - 1
    i = text.find(part, max(0, low - len(part) + 1), last)
    while i >= 0:
        kept.append(text[at : max(at, i)])
        at = max(at, i + len(part))
        i = text.find(part, i + len(part), last)
    return "".join([*kept, text[at:high]])


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, least: float = NOVELTY) -> list[tuple[int, int, int]]:
    """Bodies of private keys, and incompressible tokens in a sensitive context that touch no base span."""
    blocks = key_blocks(text)
    found = list(blocks)
    for m in LONG.finditer(text):
        token = m[0]
        begin, stop = m.span()
        if any(a < stop and begin < b for a, _, b in [*base, *blocks]):
            continue
        if not SENSITIVE.search(text[max(0, begin - CONTEXT) : begin]) and not SENSITIVE.search(text[stop : stop + CONTEXT]):
            continue
        core = max(token.split("="), key=len)  # the value, where a name stands before it
        around = without(text, max(0, begin - AROUND), begin, core) + without(text, stop, min(len(text), stop + AROUND), core)
        if novelty.marginal(around.encode(), token.encode()) >= least * len(token):
            found.append((begin, 3, stop))
    return found


def scan(text: str, novelty: Novelty) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each by start, then kind."""
    base = sorted(base_spans(text))
    return base, sorted(base + novel_spans(text, base, novelty))


def secret_spans(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """All spans of each row as a struct of three arrays; carry: see annotate."""
    tuned(docs.sparkSession)
    dictionary = trained()

    def work(b):
        novelty = novelty_of(dictionary)
        rows = [scan(t, novelty)[1] for t in whole(b.column(b.schema.get_field_index(text_col))).to_pylist()]
        return [pa.array([[KINDS[k] for _, k, _ in r] for r in rows], pa.list_(pa.string())), pa.array([[s for s, _, _ in r] for r in rows], pa.list_(pa.int32())), pa.array([[e for _, _, e in r] for r in rows], pa.list_(pa.int32()))]

    return annotate(docs, work, SPANS, carry, [text_col])


def mask(text: str, spans: list[tuple[int, int, int]], sign: str = "[secret]") -> str:
    """The text with each stretch of touching spans replaced."""
    out, at = [], 0
    for begin, _, stop in sorted(spans):
        if begin >= at:
            out += [text[at:begin], sign]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every reported span masked; a null text stays null; n_chars, where docs has it, follows the text."""
    tuned(docs.sparkSession)
    dictionary = trained()

    def work(b):
        novelty = novelty_of(dictionary)
        return [pa.array([None if t is None else mask(t, scan(t, novelty)[1]) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()], pa.string())]

    rest = [c for c in docs.columns if c != text_col]
    found, s = annotate(docs, work, T.StructType([T.StructField("masked", T.StringType())]), rest, [text_col])
    new = {text_col: F.col(f"{s}.masked")}
    if "n_chars" in rest:
        changed = fresh(docs.columns, "masked_chars")
        found = found.withColumn(changed, F.length(f"{s}.masked").cast(docs.schema["n_chars"].dataType))
        new["n_chars"] = F.coalesce(F.col(changed), F.col("n_chars"))
    return found.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


DIGEST = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of the secrets in every document."""
    docs, dictionary = read_table(tuned(spark), sf_dir, "documents").select("doc_id", "text"), trained()

    def work(b):
        novelty = novelty_of(dictionary)
        columns: list[list] = [[], [], [], [], []]
        for text in whole(b.column(1)).to_pylist():
            base, every = scan(text, novelty)
            say = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
            for k in range(3):
                columns[k].append(sum(x[1] == k for x in base))
            columns[3].append(hashlib.sha256(say(base).encode()).hexdigest())
            columns[4].append(say(every))
        return [pa.array(c, pa.int64() if i < 3 else pa.string()) for i, c in enumerate(columns)]

    found, s = annotate(docs, work, DIGEST, ["doc_id"], ["text"])
    return found.select("doc_id", f"{s}.*")
