"""An HTTP parsing service as a Spark data source and a small client; the transport can be replaced."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from docstat.functions.rules import FINAL_TASK_STATES


class ServiceError(RuntimeError):
    pass


def http(base_url: str, timeout: float = 30.0) -> Callable[[str, str, dict | None], dict]:
    def call(method: str, path: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(base_url.rstrip("/") + path, data, {"Content-Type": "application/json"}, method=method)
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return json.loads(reply.read() or b"{}")
        except OSError as error:
            raise ServiceError(f"{method} {path}: {error}") from error

    return call


class Client:
    def __init__(self, call: Callable[[str, str, dict | None], dict]):
        self.call = call

    def health(self) -> dict:
        return self.call("GET", "/health", None)

    def tasks(self, limit: int = 20) -> dict:
        return self.call("GET", f"/tasks?limit={max(0, limit)}", None)

    def submit(self, pdf_path: str, output_root: str | None = None, max_pages: int | None = None) -> dict:
        return self.call("POST", "/tasks", {k: v for k, v in (("pdf_path", pdf_path), ("output_root", output_root), ("max_pages", max_pages)) if v is not None})

    def status(self, task_id: str) -> dict:
        return self.call("GET", f"/tasks/{task_id}", None)

    def result(self, task_id: str) -> dict:
        return self.call("GET", f"/tasks/{task_id}/result", None)

    def cancel(self, task_id: str) -> dict:
        return self.call("POST", f"/tasks/{task_id}/cancel", None)

    def delete(self, task_id: str) -> dict:
        return self.call("DELETE", f"/tasks/{task_id}", None)

    def poll(self, task_id: str, limit_s: float = 1200, pause_s: float = 1.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> dict:
        """Ask until the task has ended; a task still running at the limit is marked timeout."""
        end = clock() + limit_s
        while True:
            state = self.status(task_id)
            if state.get("status") in FINAL_TASK_STATES:
                return state
            if clock() >= end:
                return state | {"timeout": True}
            sleep(max(1.0, pause_s))


class _Service:
    """What the options name: task ids, in order, and a service."""

    def __init__(self, options: dict):
        self.ids = list(dict.fromkeys(i for i in options.get("tasks", "").split(",") if i))
        self.base_url, self.factory = options.get("base_url", ""), options.get("transport", "")

    def client(self) -> Client:
        if self.factory:
            module, _, name = self.factory.partition(":")
            return Client(getattr(__import__(module, fromlist=[name]), name)())
        return Client(http(self.base_url))


class _Tasks(_Service, DataSourceReader):
    def partitions(self):
        return [InputPartition(i) for i in self.ids]

    def read(self, partition):
        result = self.client().result(partition.value)
        yield partition.value, result.get("task", result).get("status", ""), json.dumps(result)


class _TaskStream(_Service, DataSourceStreamReader):
    """Tasks as they end. An offset is the set of tasks that have arrived, by their places in the list: all below `below`, and those in `beyond`.

    It also has those of `beyond` and of the last step that ran out of time (`late`) and when the stream first asked (`asked`), so a restart goes on from it alone. The driver asks for
    the status of at most `window` open tasks at a time; results are fetched by the tasks of a batch, PER_PARTITION ids each.
    """

    PER_PARTITION = 16

    def __init__(self, options: dict):
        super().__init__(options)
        self.limit_s, self.pause_s, self.window = float(options.get("limit_s", "1200")), float(options.get("pause_s", "1")), int(options.get("window", "1000"))
        self.now: dict | None = None
        self.last_poll = 0.0

    def initialOffset(self):
        return {"below": 0, "beyond": [], "late": [], "asked": time.time()}

    def latestOffset(self):
        if self.now is None:
            self.now = self.initialOffset()
        if time.monotonic() - self.last_poll < self.pause_s:
            return self.now
        client, at = self.client(), self.now
        here, overdue, late = set(at["beyond"]), time.time() >= at["asked"] + self.limit_s, []
        waiting = [i for i in range(at["below"], len(self.ids)) if i not in here][: self.window]
        for i in waiting:
            state = client.status(self.ids[i])
            if state.get("task", state).get("status") in FINAL_TASK_STATES:
                here.add(i)
            elif overdue:
                here.add(i)
                late.append(i)
        self.last_poll = time.monotonic()
        below = at["below"]
        while below in here:
            here.discard(below)
            below += 1
        if (below, sorted(here)) != (at["below"], at["beyond"]):
            self.now = {"below": below, "beyond": sorted(here), "late": sorted({i for i in at["late"] if i in here} | set(late)), "asked": at["asked"]}
        return self.now

    def partitions(self, start, end):
        if self.now is None:  # a restart: Spark names the last offset before it asks for a new one
            self.now = end
        seen = set(start["beyond"])
        new = [i for i in [*range(start["below"], end["below"]), *end["beyond"]] if i not in seen]
        late = set(end["late"])
        rows = [(self.ids[i], i in late) for i in new]
        return [InputPartition(rows[k : k + self.PER_PARTITION]) for k in range(0, len(rows), self.PER_PARTITION)]

    def read(self, partition):
        client = self.client()
        for task, late in partition.value:
            result = client.status(task) if late else client.result(task)
            yield task, result.get("task", result).get("status", ""), json.dumps(result), late

    def commit(self, end):
        pass


class ParseTasks(DataSource):
    """Options: tasks (comma-separated ids), base_url, or transport (module:function that gives a transport)."""

    @classmethod
    def name(cls):
        return "parse_tasks"

    def schema(self):
        return "task_id string, status string, payload string"

    def reader(self, schema):
        return _Tasks(self.options)


class ParseTaskStream(DataSource):
    """The tasks of the option tasks as a stream: each arrives once, when it has ended, or with timeout = true when it is still running limit_s seconds after the stream first asked.

    Options as for parse_tasks, and limit_s, pause_s (at least so long between two polls) and window.
    """

    @classmethod
    def name(cls):
        return "parse_task_stream"

    def schema(self):
        return "task_id string, status string, payload string, timeout boolean"

    def streamReader(self, schema):
        return _TaskStream(self.options)
