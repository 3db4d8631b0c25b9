"""Gold datasets: discovery, strict TSV and lenient whitespace readers, and a TSV writer. Files of this kind are small and parsed on the driver."""

from __future__ import annotations

import csv
import logging
import math
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

logger = logging.getLogger(__name__)

HEADERS: dict[str, tuple[str, ...]] = {"ws": ("word1", "word2", "score"), "analogy": ("a", "a_prime", "b", "b_prime"), "category": ("word", "category")}
SCHEMAS = {
    "ws": "name string, ord int, line int, word1 string, word2 string, score double",
    "analogy": "name string, ord int, line int, a string, a_prime string, b string, b_prime string",
    "synonym": "name string, ord int, line int, target string, answer string, distractors array<string>",
    "category": "name string, ord int, line int, word string, category string",
}
LEAST_DISTRACTORS = 2


class MalformedDatasetError(ValueError):
    """A dataset breaks its format; the message names file and line."""


class DuplicateDatasetError(ValueError):
    """A folder has one dataset in two formats."""


def dataset_files(folder: Path) -> list[Path]:
    """The .tsv and .txt files of a folder; none if it doesn't exist."""
    found = [p for p in folder.iterdir() if p.suffix in (".tsv", ".txt")] if folder.is_dir() else []
    stems = [p.stem for p in found]
    twice = sorted({s for s in stems if stems.count(s) > 1})
    if twice:
        raise DuplicateDatasetError(f"{folder} has {twice} both as .tsv and .txt")
    return found


def discover(lang: str, kind: str, data_dir: str | Path | None = None, bundled_dir: str | Path | None = None) -> list[Path]:
    """Files of <dir>/<lang>/<kind> (or <data_dir>/<kind> where that doesn't exist) in the order of their names."""
    found: list[Path] = []
    if bundled_dir is not None:
        found += dataset_files(Path(bundled_dir) / lang / kind)
    if data_dir is not None:
        nested = Path(data_dir) / lang / kind
        found += dataset_files(nested if nested.is_dir() else Path(data_dir) / kind)
    return sorted(found, key=lambda p: p.name)


def _expected(path: Path, kind: str, header: list[str], line: int) -> tuple[str, ...]:
    if kind == "synonym":
        if len(header) < LEAST_DISTRACTORS + 2:
            raise MalformedDatasetError(f"{path.name}:{line}: a target, an answer and {LEAST_DISTRACTORS} distractors are the least")
        want = ("target", "answer", *(f"distractor{i}" for i in range(1, len(header) - 1)))
    elif kind in HEADERS:
        want = HEADERS[kind]
    else:
        raise ValueError(f"kind is {kind!r}; it can be {sorted(SCHEMAS)}")
    if tuple(header) != want:
        raise MalformedDatasetError(f"{path.name}:{line}: the header must be {list(want)}, not {header}")
    return want


def read_tsv(path: Path, kind: str) -> list[tuple[int, list[str]]]:
    """(line, fields) of a strict TSV: comments before the header only, full width, no empty field, finite scores."""
    lines = path.read_text(encoding="utf-8").split("\n")
    body = [(i, t) for i, t in enumerate(lines, 1) if t.strip()]
    while body and body[0][1].strip().startswith("#"):
        body.pop(0)
    if not body:
        raise MalformedDatasetError(f"{path.name}: no header")
    rows = [(i, next(csv.reader([t], delimiter="\t"))) for i, t in body]
    (first, header), *rest = rows
    want = _expected(path, kind, header, first)
    for line, fields in rest:
        if len(fields) != len(want):
            raise MalformedDatasetError(f"{path.name}:{line}: {len(fields)} fields instead of {len(want)}")
        if "" in fields:
            raise MalformedDatasetError(f"{path.name}:{line}: an empty field")
        if kind == "ws" and not _finite(fields[2]):
            raise MalformedDatasetError(f"{path.name}:{line}: the score {fields[2]!r} is no finite number")
    return rest


def lint_tsv(path: Path, kind: str) -> list[tuple[int, str]]:
    """(line, problem) of all that read_tsv would refuse, and not only of the first: header, comment, width, empty, score."""
    body = [(i, t) for i, t in enumerate(path.read_text(encoding="utf-8").split("\n"), 1) if t.strip()]
    while body and body[0][1].strip().startswith("#"):
        body.pop(0)
    if not body:
        return [(1, "header")]
    (first, header), *rest = [(i, next(csv.reader([t], delimiter="\t"))) for i, t in body]
    try:
        width, out = len(_expected(path, kind, header, first)), []
    except MalformedDatasetError:
        width, out = len(header), [(first, "header")]
    for line, fields in rest:
        tests = {"comment": fields[0].strip().startswith("#"), "width": len(fields) != width, "empty": "" in fields, "score": kind == "ws" and len(fields) == 3 and not _finite(fields[2])}
        out += [(line, problem) for problem, broken in tests.items() if broken]
    return out


def _finite(text: str) -> bool:
    try:
        return math.isfinite(float(text))
    except ValueError:
        return False


def read_whitespace(path: Path, kind: str) -> list[tuple[int, list[str]]]:
    """(line, fields) of the older format: blank lines and those that begin with # or : are skipped, others of a wrong width with a warning."""
    if kind not in ("ws", "analogy"):
        raise MalformedDatasetError(f"{path.name}: the kind {kind!r} needs a TSV file")
    out = []
    for line, text in enumerate(path.read_text(encoding="utf-8").split("\n"), 1):
        fields = text.split()
        if not fields or fields[0][0] in "#:":
            continue
        if len(fields) != len(HEADERS[kind]):
            logger.warning("%s:%d: %d fields instead of %d, skipped", path.name, line, len(fields), len(HEADERS[kind]))
            continue
        out.append((line, fields))
    return out


def read_gold(spark: SparkSession, lang: str, kind: str, data_dir: str | Path | None = None, bundled_dir: str | Path | None = None) -> DataFrame:
    """The rows of all datasets of a kind, named <lang>_<file stem>, with their place in file-name order."""
    rows = []
    for place, path in enumerate(discover(lang, kind, data_dir, bundled_dir)):
        for line, f in (read_tsv if path.suffix == ".tsv" else read_whitespace)(path, kind):
            head = (f"{lang}_{path.stem}", place, line)
            if kind == "ws":
                rows.append((*head, f[0], f[1], float(f[2])))
            elif kind == "synonym":
                rows.append((*head, f[0], f[1], f[2:]))
            else:
                rows.append((*head, *f))
    return spark.createDataFrame(rows, SCHEMAS[kind])


def read_pairs(path: str | Path) -> list[tuple[int, str, str]]:
    """(line, left, right) of a two-column TSV glossary; blank lines and comments are skipped, anything else of another form raises."""
    out = []
    for line, text in enumerate(Path(path).read_text(encoding="utf-8").split("\n"), 1):
        if not text.strip() or text.lstrip().startswith("#"):
            continue
        fields = [x.strip() for x in text.split("\t")]
        if len(fields) != 2 or not all(fields):
            raise MalformedDatasetError(f"{path}:{line}: two fields with a TAB between them are expected")
        out.append((line, *fields))
    return out


def read_base_pairs(path: str | Path) -> list[tuple[int, str, str]]:
    """(line, left, right): the first two of two or more TAB-separated fields."""
    out = []
    for line, text in enumerate(Path(path).read_text(encoding="utf-8").split("\n"), 1):
        if not text.strip() or text.startswith("#"):
            continue
        fields = text.split("\t")
        if len(fields) < 2:
            raise MalformedDatasetError(f"{path}:{line}: TAB-separated fields are expected")
        out.append((line, fields[0].strip(), fields[1].strip()))
    return out


def write_tsv(path: str | Path, header: Sequence[str], rows: Sequence[Sequence[object]], preamble: dict[str, str] | None = None) -> None:
    """A strict TSV: `# key: value` lines, the header, the rows."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", encoding="utf-8", newline="") as f:
        f.writelines(f"# {k}: {v}\n" for k, v in (preamble or {}).items())
        out = csv.writer(f, delimiter="\t", lineterminator="\n")
        out.writerow(header)
        out.writerows(rows)
