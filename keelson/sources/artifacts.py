"""Files of a run: a private folder with plan and report, replaced as a whole; hooks; locks; saved runs."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import SparkSession

from keelson.plans.model import HookPlan, MigrationPlan, RunReport, Status, from_dict, to_json

SECRET = re.compile(r"\b(password|passwd|pwd|token|secret)(\s*[=:]\s*)(\"[^\"]*\"|'[^']*'|[^\s,;&]+)", re.I)


def safe(text: str) -> str:
    """For display: addresses and secrets out, control characters escaped."""
    text = re.sub(r"\b[A-Za-z][\w+.-]*://\S+", "[redacted-uri]", text)
    text = SECRET.sub(r"\1\2[redacted]", text)
    return "".join(c if c.isprintable() or c == " " else c.encode("unicode_escape").decode() for c in text)


def new_run_dir(base: str, run_id: str) -> Path:
    """A folder that didn't exist and that only its owner can read."""
    path = Path(base) / run_id
    path.parent.mkdir(parents=True, exist_ok=True)
    path.mkdir(mode=0o700)
    return path


def replace(path: Path, text: str) -> None:
    """Write beside the file, flush to disk and move over it."""
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=path.name)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)


def write_plan(folder: Path, plan: MigrationPlan) -> str:
    text = to_json(plan, indent=1)
    replace(folder / "plan.json", text)
    return hashlib.sha256(text.encode()).hexdigest()


def write_report(folder: Path, report: RunReport) -> None:
    replace(folder / "report.json", to_json(report, indent=1))


class SavedRunError(ValueError):
    pass


def saved_run(folder: str | Path, source_digest: str = "", target_digest: str = "") -> tuple[MigrationPlan, RunReport]:
    """Plan and report of a run, if they belong together, are of this version and complete, and name the endpoints that are given."""
    folder = Path(folder)
    text = (folder / "plan.json").read_text("utf-8")
    plan, report = from_dict(MigrationPlan, json.loads(text)), from_dict(RunReport, json.loads((folder / "report.json").read_text("utf-8")))
    if report.artifact_dir and Path(report.artifact_dir).resolve() != folder.resolve():
        raise SavedRunError("the report belongs to another folder")
    if hashlib.sha256(text.encode()).hexdigest() != report.plan_sha256:
        raise SavedRunError("the plan isn't the one that ran")
    if {t.id for t in plan.tables} != {t.id for t in report.tables} or (plan.mode, plan.consistency) != (report.mode, report.consistency):
        raise SavedRunError("plan and report have other tables")
    if (plan.version, report.version) != (1, 1):
        raise SavedRunError("the run is of another version")
    if any(t.status not in (Status.COMPLETE, Status.PARTIAL) for t in report.tables):
        raise SavedRunError("the run didn't load all of its tables")
    for side, now, then in (("source", source_digest, report.source_endpoint_sha256), ("target", target_digest, report.target_endpoint_sha256)):
        if now and then and now != then:
            raise SavedRunError(f"the run was made with another {side}")
    return plan, report


def endpoint_digest(url: str) -> str:
    """Of an address without password, query and fragment."""
    u = urlsplit(url)
    user = f"{u.username}@" if u.username else ""
    port = f":{u.port}" if u.port else ""
    return hashlib.sha256(f"{u.scheme}://{user}{u.hostname or ''}{port}{u.path}".encode()).hexdigest()


def resolve_url(url_env: str | None, url_file: str | None, environment: dict[str, str] = os.environ) -> str:
    text = environment.get(url_env) if url_env else Path(url_file).read_text("utf-8").strip()  # a name that isn't set gives nothing
    if not text:
        raise ValueError("the credential reference gives nothing")
    return text


def known_digest(endpoint) -> str:
    """The digest of a configured endpoint's address, or nothing where its reference gives none."""
    try:
        return endpoint_digest(resolve_url(endpoint.url_env, endpoint.url_file))
    except (KeyError, OSError, ValueError):
        return ""


def run_hooks(spark: SparkSession, hooks: list[HookPlan], before: bool) -> None:
    """Run reviewed SQL files, one statement for each line that ends with a semicolon; a file that has changed since planning is refused."""
    for h in (h for h in hooks if h.before == before):
        data = Path(h.path).read_bytes()
        if hashlib.sha256(data).hexdigest() != h.sha256:
            raise ValueError(f"hook {h.path} has changed since it was planned")
        for statement in re.split(r";\s*(?:\n|\Z)", data.decode()):
            if statement.strip():
                spark.sql(statement)


@contextmanager
def schema_locks(folder: str, schemas: list[str]) -> Iterator[None]:
    """Hold a lock file for each schema, in sorted order; fail if another run holds one."""
    held = []
    try:
        for s in sorted(set(schemas)):
            path = os.path.join(folder, hashlib.sha256(s.encode()).hexdigest()[:16] + ".lock")
            os.makedirs(folder, exist_ok=True)
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600))
            held.append(path)
        yield
    except FileExistsError as e:
        raise RuntimeError("another run holds a destination schema") from e
    finally:
        for path in held:
            os.unlink(path)
