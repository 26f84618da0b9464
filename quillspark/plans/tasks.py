"""Named tasks with dependencies, run in waves: each wave's tasks may run Spark jobs at the same time."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from quillspark.operators.graph import Graph


@dataclass
class Task:
    name: str
    run: Callable[[Mapping], object]
    after: tuple[str, ...] = ()
    status: str = "pending"
    result: object = None


@dataclass
class TaskFlow:
    """Tasks read the results so far as a mapping. The first failure stops the flow."""

    workers: int = 4
    tasks: dict[str, Task] = field(default_factory=dict)

    def add(self, name: str, run: Callable[[Mapping], object], after: tuple[str, ...] = ()) -> Task:
        if not name:
            raise ValueError("a task needs a name")
        if name in self.tasks:
            raise ValueError(f"task {name!r} is there already")
        self.tasks[name] = Task(name, run, tuple(after))
        return self.tasks[name]

    def graph(self) -> Graph:
        if missing := sorted({d for t in self.tasks.values() for d in t.after} - set(self.tasks)):
            raise ValueError(f"undefined tasks: {missing}")
        return Graph([(d, t.name) for t in self.tasks.values() for d in t.after], self.tasks)

    def run(self, context: Mapping | None = None) -> dict[str, object]:
        order = self.graph().order()
        results = dict(context or {})
        with ThreadPoolExecutor(self.workers) as pool:
            while order:
                wave = [n for n in order if all(self.tasks[d].status == "done" for d in self.tasks[n].after)]
                seen = dict(results)
                futures = {n: pool.submit(self.tasks[n].run, seen) for n in wave}
                for n in wave:
                    task = self.tasks[n]
                    try:
                        task.result, task.status = futures[n].result(), "done"
                    except Exception:
                        task.status = "failed"
                        for f in futures.values():
                            f.cancel()
                        raise
                    results[n] = task.result
                order = [n for n in order if n not in wave]
        return results
