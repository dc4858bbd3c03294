"""Patterns, labels and state tables that results depend on."""

# Scheduler job states: 1 = error, 2 = the job can still be waited for.
STATE_FLAGS = {
    "PEND": 2,
    "RUN": 2,
    "DONE": 0,
    "EXIT": 0,
    "WAIT": 2,
    "PSUSP": 2,
    "USUSP": 2,
    "SSUSP": 2,
    "UNKWN": 1,
}
DEFAULT_STATE_FLAGS = 2

# Scheduler text output.
JOB_LIST = (
    r"^(?P<jID>\d+)\s+(?P<user>\w+)\s+(?P<jState>[A-Z]+)\s+(?P<queue>\w+)"
    r"\s+(?P<submHost>[\w\.]+)\s+(?P<execHost>[\w.\-]+)\s+(?P<jName>[\w.\-\[\]]+)"
    r"\s+(?P<jSubTime>.+?)\s*$"
)
QUEUE_LIST = (
    r"^(?P<jobID>\d+\.\d+)\s+(?P<user>\w+)\s+(?P<submTimedate>\d{1,2}\/\d{1,2}\s+[\d:]+)"
    r"\s+(?P<runTime>[\d+:]+)\s+(?P<jobState>[>HRICXS<])\s+(?P<priority>\d+)"
    r"\s+(?P<memSize>\d+\.\d+)\s+(?P<cmd>.+)$"
)
JOB_SUBMITTED = (
    r"^Job <(?P<jID>\d+)> is submitted to(?: default)? queue <(?P<queue>[^>]+)>\.$"
)
ID_RANGE = r"(?P<JIDRngBgn>\d+\.\d+)\s+-\s+(?P<JIDRngEnd>\d+\.\d+)"
CLUSTER_SUBMITTED = r"^(?P<nJobs>\d+) job\(s\) submitted to cluster (?P<clusterID>\d+)\."
KEY_VALUE = r"^(?P<description>.+)\s+:\s(?P<value>.+)$"

# Path manifest key: [!]name[@alias].
MANIFEST_KEY = r"^(?P<isFile>!?)(?P<nmTmpl>[^@\n]+)(?:@(?P<alias>[_\-\w]+))?$"

# Reference inside a text: $(GROUP:ID). Group names have no digit 0.
REFERENCE = r"\$\(([a-zA-Z_][a-zA-Z1-9_]*):((?:\\[($)]|[^($)])*)\)"
MAX_SUBSTITUTIONS = 255

# Override expressions of a configuration layer.
SET_EXPRESSION = r"^(?P<name>[A-Za-z][\w.-]+)=(?P<value>(?:\\,|[^,\n])+)$"
UNDEF_EXPRESSION = r"^~(?P<name>[A-Za-z][\w.-]+)$"

# Template files: hidden files and editor swap files are left out.
TEMPLATE_FILE = r"^(?P<dir>.+\/)?(?P<filename>[^.~#]\w*)(?:\.(?P<extension>\w+))?$"
IGNORED_TEMPLATES = ["*/README.md"]

# Labels a task record may carry besides its name and processes.
TASK_LABELS = ["username", "config", "tags", "emailNotify", "comment"]
# Keys an event record must carry.
EVENT_KEYS = ["task_id", "process"]
