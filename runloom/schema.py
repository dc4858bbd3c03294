"""Fixed schemas of the monitoring tables, and the column groups operators key on."""

from __future__ import annotations

from pyspark.sql import types as T

PROC = ("task_id", "process")
UNIT = ("task_id", "process", "array_index")

# Process kinds (fixed values).
STANDALONE = 1
ARRAY = 3


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _I, _L, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()

TASKS = _struct(task_id=_S, name=_S, username=_S, email_notify=_S, comment=_S,
                submitted_at=_TS, hostname=_S, config=_S)
TASK_TAGS = _struct(task_id=_S, tag=_S)
PROCESSES = _struct(task_id=_S, process=_S, threshold_progress=_I, kin=_I, n_jobs=_I,
                    f_tolerance=_I)
EVENTS = _struct(event_id=_L, task_id=_S, process=_S, array_index=_I, event_class=_S,
                 progress=_I, payload=_S, sent_at=_TS, received_at=_TS, hostname=_S,
                 client_ip=_S)

# Wire form of one event record and of one task record (``_meta`` travels inside the record).
_META = _struct(host=_S, time=_S)
EVENT_RECORD = T.StructType([
    T.StructField("_meta", _META), T.StructField("event_id", _L),
    T.StructField("task_id", _S), T.StructField("process", _S),
    T.StructField("array_index", _I), T.StructField("event_class", _S),
    T.StructField("payload", _S), T.StructField("progress", _I),
    T.StructField("received_at", _TS),
])
TASK_RECORD = T.StructType([
    T.StructField("_meta", _META), T.StructField("task_id", _S),
    T.StructField("tags", T.ArrayType(_S)), T.StructField("config", _S),
    T.StructField("processes", T.MapType(_S, _S)),
])
