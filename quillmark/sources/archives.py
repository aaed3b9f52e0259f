"""Archives on the driver: safe unpacking, byte-stable packing, and the choice of members."""

from __future__ import annotations

import gzip
import hashlib
import json
import shutil
import tarfile
import unicodedata
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import BinaryIO, NamedTuple


class Refused(ValueError):
    pass


def unpack_zip(archive: str | Path, place: str | Path) -> None:
    root = Path(place).resolve()
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if root not in (root / name).resolve().parents:
                raise Refused(f"{name} would leave {root}")
        z.extractall(root)


def unpack_tar(archive: str | Path, place: str | Path) -> None:
    with tarfile.open(archive) as t:
        t.extractall(place, filter="data")


def stable_gzip(source: BinaryIO, path: str | Path) -> None:
    """The same bytes for the same content: no name, no time."""
    with stable_gzip_file(path) as z:
        shutil.copyfileobj(source, z)


@contextmanager
def stable_gzip_file(path: str | Path) -> Iterator[BinaryIO]:
    with open(path, "wb") as f, gzip.GzipFile(filename="", mode="wb", fileobj=f, mtime=0) as z:
        yield z


def scrub_tar(archive: str | Path, path: str | Path) -> None:
    """Files in the order of their names, without owners, times or extended headers."""
    with tarfile.open(archive) as old:
        names = sorted((m.name for m in old if m.isfile()))
    with tarfile.open(archive) as old, stable_gzip_file(path) as out, tarfile.open(fileobj=out, mode="w|", format=tarfile.USTAR_FORMAT) as new:
        for name in names:
            member = old.getmember(name)
            bare = tarfile.TarInfo(name)
            bare.size, bare.mode = member.size, 0o644
            new.addfile(bare, old.extractfile(member))


def only_member(names: Iterable[str], suffix: str) -> str:
    """The one name that ends so, composed characters or not."""
    found = [n for n in names if unicodedata.normalize("NFC", n).endswith(suffix)]
    if len(found) != 1:
        raise Refused(f"{len(found)} members end in {suffix}")
    return found[0]


def sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def missing_inputs(place: str | Path, expected: dict[str, str], source: str | None = None) -> list[str]:
    """Names that are not there. Files come from elsewhere: nothing is downloaded, and a
    source that is not an https release is refused before anything else happens."""
    if source is not None and not source.startswith("https://github.com/"):
        raise Refused("raw data can't be fetched from there")
    return [n for n in expected if not (Path(place) / n).is_file()]


def check_inputs(place: str | Path, expected: dict[str, str]) -> None:
    """Refuse a folder in which a file of ``expected`` (name to sha256) is missing or differs."""
    gone = missing_inputs(place, expected)
    wrong = [n for n, digest in expected.items() if n not in gone and sha256(Path(place) / n) != digest]
    if gone or wrong:
        raise Refused("; ".join(f"{what}: {', '.join(names)}" for what, names in (("missing", gone), ("another hash", wrong)) if names))


# The names that a call log's fields have in the published file.
CALL_FIELDS = {
    "slot_id": "슬롯id",
    "model": "요청모델",
    "status": "상태",
    "post_id": "게시물id",
    "post_time": "게시물시각",
    "comment": "댓글",
    "settings_hash": "설정해시",
}
CALL_KIND, SLOT = "종류", "슬롯"


class Conversion(NamedTuple):
    """What an archive becomes. A source is named by the end of its path, which one member has."""

    zips: dict[str, dict[str, tuple]]  # zip's name to, for each source, its date
    copies: dict[str, str] = {}  # source to a file of the same bytes
    packed: dict[str, str] = {}  # source to a byte-stable gzip of it
    settings: dict[str, str] = {}  # source, a JSON object, to one whose settings are redacted
    calls: str = ""  # what the path of a call log has in it
    n_calls: int = 5
    calls_to: str = "calls.jsonl.gz"


def convert_archive(archive: str | Path, place: str | Path, plan: Conversion, redact: Callable[[dict], dict]) -> None:
    """Write the inputs that ``plan`` makes of a tar's members, straight from the archive."""
    place = Path(place)
    with tarfile.open(archive) as tar:
        members = {m.name: m for m in tar if m.isfile()}
        opened = lambda end: tar.extractfile(members[only_member(members, end)])
        logs = sorted((n for n in members if plan.calls and plan.calls in unicodedata.normalize("NFC", n) and n.endswith(".jsonl")), key=lambda n: Path(n).name)
        if plan.calls and len(logs) != plan.n_calls:
            raise Refused(f"{len(logs)} call logs, not {plan.n_calls}")
        for name, files in plan.zips.items():
            with zipfile.ZipFile(place / f"{name}.zip", "w") as z:
                for end, date in files.items():
                    info = zipfile.ZipInfo(f"{name}/{Path(end).name}", date)
                    info.create_system, info.external_attr = 3, 0o100644 << 16  # as made on Unix: a plain file
                    with opened(end) as source:
                        z.writestr(info, source.read(), zipfile.ZIP_DEFLATED, 6)
        for end, target in plan.copies.items():
            with opened(end) as source, open(place / target, "wb") as out:
                shutil.copyfileobj(source, out)
        for end, target in plan.packed.items():
            with opened(end) as source:
                stable_gzip(source, place / target)
        for end, target in plan.settings.items():
            with opened(end) as source, stable_gzip_file(place / target) as out:
                out.write((json.dumps(redact(json.load(source)), ensure_ascii=False, indent=1) + "\n").encode())
        if plan.calls:
            with stable_gzip_file(place / plan.calls_to) as out:
                for name in logs:
                    for record in slot_records(tar.extractfile(members[name]), Path(name).name):
                        out.write((json.dumps(record, ensure_ascii=False) + "\n").encode())


def slot_records(lines: Iterable[bytes], source: str) -> Iterator[dict]:
    """Records of slots with public names, and where they stand: a line's number counts from 1."""
    for number, line in enumerate(lines, 1):
        record = json.loads(line)
        if record.get(CALL_KIND) == SLOT:
            yield {"source_file": source, "source_line": number} | {public: record.get(own) for public, own in CALL_FIELDS.items()}
