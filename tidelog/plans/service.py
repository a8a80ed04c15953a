"""The engine behind the calls of a service, a client that routes between copies, and a line-based shell."""

from __future__ import annotations

import time
from collections.abc import Iterator

from tidelog.model import Conflict, InvalidRecord, KeyNotFound, StoreError, Write, checked_batch
from tidelog.operators.stats import CallMetrics
from tidelog.operators.transactions import Registry
from tidelog.plans.engine import Engine, retry
from tidelog.streaming.replication import Manager


def _key(key: bytes) -> bytes:
    return Write.delete(key).checked().key


class Service:
    """One method for each call; absent keys are told by a flag, everything else that is wrong by an exception."""

    def __init__(self, engine: Engine, manager: Manager | None = None):
        self.engine, self.registry, self.manager = engine, Registry(engine), manager or Manager(engine)

    def get(self, key: bytes) -> tuple[bytes, bool]:
        try:
            return self.engine.get(_key(key)), True
        except KeyNotFound:
            return b"", False

    def put(self, key: bytes, value: bytes, sync: bool = False) -> bool:
        self.engine.put(key, value)
        if sync:
            self.engine.sync()
        return True

    def delete(self, key: bytes, sync: bool = False) -> bool:
        self.engine.delete(key)
        if sync:
            self.engine.sync()
        return True

    def batch_write(self, writes: list[Write], sync: bool = False) -> bool:
        return self.engine.batch_write(checked_batch(writes))

    def scan(self, **options) -> Iterator[tuple[bytes, bytes]]:
        return iter(self.engine.scanner(**options))

    def begin_transaction(self, read_only: bool = False, connection: str = "") -> str:
        return self.registry.begin(read_only, connection)

    def commit_transaction(self, tx: str) -> bool:
        try:
            self.registry.get(tx).commit()
        finally:
            self.registry.remove(tx)
        return True

    def rollback_transaction(self, tx: str) -> bool:
        try:
            self.registry.get(tx).rollback()
        finally:
            self.registry.remove(tx)
        return True

    def tx_get(self, tx: str, key: bytes) -> tuple[bytes, bool]:
        try:
            return self.registry.get(tx).get(_key(key)), True
        except KeyNotFound:
            return b"", False

    def tx_put(self, tx: str, key: bytes, value: bytes) -> bool:
        self.registry.get(tx).put(key, value)
        return True

    def tx_delete(self, tx: str, key: bytes) -> bool:
        self.registry.get(tx).delete(key)
        return True

    def tx_scan(self, tx: str, **options) -> Iterator[tuple[bytes, bytes]]:
        for r in self.registry.get(tx).scan(**options).toLocalIterator():
            yield bytes(r.key), bytes(r.value)

    def get_stats(self, prefix: str = "") -> dict:
        return self.engine.get_stats(prefix)

    def compact(self, force: bool = False) -> bool:
        """Flush and compact; nothing is written to the keyspace."""
        self.engine.flush()
        if force:
            self.engine.compact_range()
        else:
            self.engine.compact()
        return True

    def get_node_info(self) -> dict:
        return self.manager.node_info()


#: Errors that another try may not meet.
TRANSIENT = (Conflict, ConnectionError, TimeoutError)


class Client:
    """Reads from the first copy, from the primary where a copy fails; writes to the primary. Calls that fail for a passing
    reason are made again, with doubling pauses that vary by chance; every try is counted."""

    def __init__(self, primary: Service, replicas: list[Service] = (), retries: int = 3, first_s: float = 0.1, most_s: float = 2.0, jitter: float = 0.2):
        self.primary, self.replicas, self.metrics = primary, list(replicas), CallMetrics()
        self._pauses = {"retries": retries, "first_s": first_s, "most_s": most_s, "jitter": jitter}

    def _call(self, service: Service, name: str, *args, **options):
        sent = sum(len(x) for x in args if isinstance(x, bytes)) + sum(len(w.key) + len(w.value or b"") for x in args if isinstance(x, list) for w in x)

        def once():
            began = time.perf_counter_ns()
            try:
                out = getattr(service, name)(*args, **options)
            except BaseException:
                self.metrics.record(name, time.perf_counter_ns() - began, False, sent)
                raise
            received = len(out[0]) if isinstance(out, tuple) else 0
            self.metrics.record(name, time.perf_counter_ns() - began, True, sent, received)
            return out

        return retry(once, again=TRANSIENT, **self._pauses)

    def _read(self, name: str, *args, **options):
        for service in [*self.replicas[:1], self.primary]:
            try:
                return self._call(service, name, *args, **options)
            except (StoreError, *TRANSIENT):
                if service is self.primary:
                    raise

    def get(self, key: bytes) -> tuple[bytes, bool]:
        return self._read("get", key)

    def scan(self, **options) -> Iterator[tuple[bytes, bytes]]:
        return self._read("scan", **options)

    def put(self, key: bytes, value: bytes, sync: bool = False) -> bool:
        return self._call(self.primary, "put", key, value, sync=sync)

    def delete(self, key: bytes, sync: bool = False) -> bool:
        return self._call(self.primary, "delete", key, sync=sync)

    def batch_write(self, writes: list[Write], sync: bool = False) -> bool:
        return self._call(self.primary, "batch_write", writes, sync=sync)


class Shell:
    """Commands as lines of text, answers as text."""

    HELP = ".help .stats .flush .exit BEGIN [READONLY] COMMIT ROLLBACK PUT key value GET key DELETE key SCAN [prefix | SUFFIX s | RANGE a b | a b]"

    def __init__(self, engine: Engine):
        self.engine, self.tx = engine, None

    def run(self, line: str) -> str:
        words = line.split()
        if not words:
            return ""
        try:
            return self._run(words[0].upper() if not words[0].startswith(".") else words[0].lower(), words[1:])
        except KeyNotFound:
            return "not found"
        except (StoreError, IndexError, ValueError) as error:
            return f"error: {error}"

    def _run(self, verb: str, rest: list[str]) -> str:
        raw = [w.encode() for w in rest]
        target = self.tx or self.engine
        if verb == ".help":
            return self.HELP
        if verb == ".stats":
            return "\n".join(f"{k}: {v}" for k, v in sorted(self.engine.get_stats().items()))
        if verb == ".flush":
            self.engine.flush()
        elif verb in (".close", ".exit"):
            if self.tx:
                self.tx.rollback()
                self.tx = None
            self.engine.close()
        elif verb == "BEGIN":
            if self.tx:
                raise StoreError("a transaction is open")
            self.tx = self.engine.begin(read_only=rest[:1] == ["READONLY"])
        elif verb in ("COMMIT", "ROLLBACK"):
            if not self.tx:
                raise StoreError("no transaction is open")
            tx, self.tx = self.tx, None
            tx.commit() if verb == "COMMIT" else tx.rollback()
        elif verb == "PUT":
            if len(raw) < 2:
                raise InvalidRecord("PUT takes a key and a value")
            target.put(raw[0], b" ".join(raw[1:]))
        elif verb == "DELETE":
            target.delete(raw[0])
        elif verb == "GET":
            return target.get(raw[0]).decode(errors="replace")
        elif verb == "SCAN":
            return "\n".join(f"{bytes(r.key).decode(errors='replace')}: {bytes(r.value).decode(errors='replace')}" for r in target.scan(**self._bounds(rest, raw)).toLocalIterator())
        else:
            raise ValueError(f"unknown command {verb}; {self.HELP}")
        return "ok"

    @staticmethod
    def _bounds(rest: list[str], raw: list[bytes]) -> dict:
        if not rest:
            return {}
        if rest[0].upper() == "SUFFIX" and len(rest) == 2:
            return {"suffix": raw[1]}
        if rest[0].upper() == "RANGE" and len(rest) == 3:
            return {"start": raw[1], "end": raw[2]}
        return {"prefix": raw[0]} if len(rest) == 1 else {"start": raw[0], "end": raw[1]}


def main() -> None:
    import sys

    from tidelog.session import local_session

    with Engine(local_session("shell"), sys.argv[1]) as engine:
        shell = Shell(engine)
        while not engine.closed and (line := sys.stdin.readline()):
            print(shell.run(line), flush=True)


if __name__ == "__main__":
    main()
