"""The seam for external runs: compilers and models are outside the engine and come in as a callable."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, StringType, StructType

Runner = Callable[[list[str]], tuple[int, str]]
#: Fixed value: seconds a command may take.
LIMIT = 10.0


def _serve(runner: Runner, pipe) -> None:
    """Answers commands one by one until the pipe is closed."""
    while True:
        try:
            command = pipe.recv()
        except EOFError:
            return
        try:
            code, text = runner(command)
            pipe.send(("SUCCESS" if code == 0 else "ERROR", text))
        except TimeoutError:
            pipe.send(("TIMEOUT", ""))
        except Exception as e:  # noqa: BLE001 - the task must go on with the next command
            pipe.send(("ERROR", f"{type(e).__name__}: {e}"))


class Worker:
    """A process that runs commands; one that overruns its time is killed and replaced."""

    def __init__(self, runner: Runner, limit: float):
        self.runner, self.limit, self.process = runner, limit, None

    def _start(self) -> None:
        context = multiprocessing.get_context("fork")
        self.pipe, theirs = context.Pipe()
        self.process = context.Process(target=_serve, args=(self.runner, theirs), daemon=True)
        self.process.start()
        theirs.close()

    def stop(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
            self.process = None

    def run(self, command: list[str]) -> tuple[str, str]:
        if self.process is None:
            self._start()
        try:
            self.pipe.send(command)
            if self.pipe.poll(self.limit):
                return self.pipe.recv()
        except (EOFError, OSError):  # the process died of the command
            self.stop()
            return "ERROR", "the runner ended"
        self.stop()
        return "TIMEOUT", ""


def run_variants(variants: DataFrame, runner: Runner, command: str = "command", original: str | None = None, limit: float = LIMIT) -> DataFrame:
    """Adds status (SUCCESS, ERROR or TIMEOUT) and message.  ``runner`` takes a command and returns exit code and stderr.

    A command that takes more than ``limit`` seconds is a TIMEOUT whatever the runner does: it runs in a process of its own
    for each batch, which is killed and replaced then.  A TimeoutError of the runner is one as well; what the command said
    is discarded.  Other exceptions, and a process that dies, are an ERROR.  With ``original``, the column of the unchanged
    command, that is run as well and ``original_ok`` tells whether it still succeeds.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            worker = Worker(runner, limit)
            try:
                done = [worker.run(list(c)) for c in b[command]]
                more = {"original_ok": [worker.run(list(c))[0] == "SUCCESS" for c in b[original]]} if original else {}
            finally:
                worker.stop()
            yield b.assign(status=[s for s, _ in done], message=[t for _, t in done], **more)

    schema = StructType(list(variants.schema.fields)).add("status", StringType()).add("message", StringType())
    return variants.mapInPandas(run, schema.add("original_ok", BooleanType()) if original else schema)
