"""Task records in a directory: one JSON file a task, a research document and a plan beside it, and a pointer to the current task."""

from __future__ import annotations

import datetime
import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import tasks


class NotReady(ValueError):
    """A step whose preconditions aren't met."""


class Records:
    def __init__(self, root: str):
        self.root = os.path.expanduser(root)

    def _dir(self, task_id: str) -> str:
        return os.path.join(self.root, "tasks", task_id)

    def save(self, task: dict) -> None:
        os.makedirs(self._dir(task["id"]), exist_ok=True)
        with open(os.path.join(self._dir(task["id"]), "task.json"), "w", encoding="utf-8") as f:
            json.dump(task, f, indent=2, default=str)

    def load(self, task_id: str) -> dict:
        with open(os.path.join(self._dir(task_id), "task.json"), encoding="utf-8") as f:
            return json.load(f)

    def create(self, prompt: str) -> dict:
        """A new task; it becomes the current one."""
        task = tasks.created(prompt)
        self.save(task)
        self.switch(task["id"])
        return self.load(task["id"])

    def switch(self, task_id: str | None) -> None:
        os.makedirs(self.root, exist_ok=True)
        with open(os.path.join(self.root, "current"), "w", encoding="utf-8") as f:
            f.write(task_id or "")

    def current(self) -> str | None:
        try:
            with open(os.path.join(self.root, "current"), encoding="utf-8") as f:
                return f.read().strip() or None
        except FileNotFoundError:
            return None

    def delete(self, task_id: str) -> None:
        shutil.rmtree(self._dir(task_id))
        if self.current() == task_id:
            self.switch(None)

    def by_prefix(self, prefix: str) -> str:
        found = [t for t in os.listdir(os.path.join(self.root, "tasks")) if t.startswith(prefix)]
        if len(found) != 1:
            raise LookupError(f"{len(found)} tasks begin with {prefix}")
        return found[0]

    def _step(self, task_id: str, phase: str, field: str, value: str) -> dict:
        task = self.load(task_id)
        if task["phase"] != phase:
            raise NotReady(f"the task is in the phase {task['phase']}")
        task |= {field: value, "updated_at": datetime.datetime.now(datetime.UTC)}
        self.save(task)
        return self.load(task_id)

    def set_research(self, task_id: str, doc: dict) -> dict:
        with open(os.path.join(self._dir(task_id), "research.md"), "w", encoding="utf-8") as f:
            f.write(tasks.markdown(doc))
        return self._step(task_id, "research", "research_doc", json.dumps(doc))

    def set_plan(self, task_id: str, plan: dict) -> dict:
        with open(os.path.join(self._dir(task_id), "plan.yaml"), "w", encoding="utf-8") as f:
            f.write(to_yaml(plan))
        return self._step(task_id, "planning", "plan", json.dumps(plan))

    def advance(self, task_id: str) -> dict:
        task = self.load(task_id)
        ready = {"research": task["research_doc"] is not None, "planning": task["plan"] is not None, "agent": True, "complete": False}[task["phase"]]
        if not ready:
            raise NotReady(f"the task can't leave the phase {task['phase']}")
        task |= {"phase": schemas.PHASES[schemas.PHASES.index(task["phase"]) + 1], "updated_at": datetime.datetime.now(datetime.UTC)}
        self.save(task)
        return self.load(task_id)

    def table(self, spark: SparkSession) -> DataFrame:
        """All tasks as rows; folders without a valid record are left out."""
        if not os.path.isdir(os.path.join(self.root, "tasks")):
            return spark.createDataFrame([], schemas.Task)
        rows = spark.read.schema(schemas.Task).json(os.path.join(self.root, "tasks", "*", "task.json"), multiLine=True, mode="DROPMALFORMED")
        return tasks.listing(rows.where(F.col("id").isNotNull()))


def to_yaml(record: dict) -> str:
    import yaml

    return yaml.safe_dump(record, sort_keys=False, allow_unicode=True)


def from_yaml(text: str) -> dict:
    import yaml

    return yaml.safe_load(text)


def plans(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Plans from YAML as rows."""
    return spark.createDataFrame([tuple(from_yaml(t)[c] for c in schemas.Plan.fieldNames()) for t in texts], schemas.Plan)
