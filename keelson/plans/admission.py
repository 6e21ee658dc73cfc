"""Arithmetic of a run's memory and connections. Spark manages memory itself; the numbers are checked so that a configuration means the same as ever."""

from __future__ import annotations

from dataclasses import dataclass

POSITION = 48  # bytes kept for a row of a batch
FIXED = 64 << 10


class AdmissionError(ValueError):
    pass


def batch_bytes(m) -> int:
    return m.batch_bytes + m.batch_rows * POSITION


def workspace_bytes(m) -> int:
    row = m.max_row_bytes
    return 3 * row + max(8, 2 * (row + 4)) + max(16, 2 * row) + FIXED


def reservation(m) -> int:
    """Bytes of one table's pipeline: queued batches, one in work, one being filled, and the workspace."""
    for part in (batch_bytes(m), workspace_bytes(m)):
        if part >= 2**32:
            raise AdmissionError("a reservation exceeds 32 bits")
    return (m.queue_batches + 2) * batch_bytes(m) + workspace_bytes(m)


@dataclass(frozen=True)
class Admission:
    table_workers: int
    reader_workers: int
    index_workers: int
    source_connections: int
    target_connections: int
    peak_target_connections: int


def admit(m, consistency: str, tables: int, index_jobs: int, artifact_bytes: int = 0) -> Admission:
    """How many workers fit; fewer than asked for if memory says so, an error if not even one does."""
    if consistency == "single_snapshot" and (m.table_workers, m.readers_per_table) != (1, 1):
        raise AdmissionError("a single snapshot has one worker and one reader")
    if m.readers_per_table > 1 and (consistency != "frozen" or not m.max_key_span):
        raise AdmissionError("several readers need a frozen source and a key span")
    tables = 0 if m.mode == "schema_only" else tables
    asked = min(m.table_workers, tables)
    room = max(0, m.memory_bytes - artifact_bytes) // reservation(m)
    workers = min(asked, min(asked * m.readers_per_table, room) // m.readers_per_table)
    if artifact_bytes > m.memory_bytes or (tables and not workers):
        raise AdmissionError(f"memory_bytes must be at least {artifact_bytes + reservation(m)}")
    readers, indexes = workers * m.readers_per_table, min(m.index_workers, index_jobs)
    target = max(readers, indexes) + 1
    return Admission(workers, readers, indexes, 2 if consistency == "single_snapshot" else readers + 1, target, 2 * target)
