"""Fixed values of the data model. They must not be changed: stored data depends on them."""

PENDING = "pending"
RUNNING = "running"
SUCCESS = "success"
FAILED = "failed"
FINAL_FAILED = "final_failed"
STATUSES = (PENDING, RUNNING, SUCCESS, FAILED, FINAL_FAILED)
ACTIVE = (PENDING, RUNNING)
SETTLED = (SUCCESS, FAILED, FINAL_FAILED)
UNSUCCESSFUL = (FAILED, FINAL_FAILED)

MANUAL = "manual"
SCHEDULED = "scheduled"
DEPENDENCY = "dependency"
TRIGGERS = (MANUAL, SCHEDULED, DEPENDENCY)

NORMAL = "normal"
RETRY = "retry"
QUEUES = (NORMAL, RETRY, SCHEDULED)

ACTION_TYPES = ("http", "shell")
POLICIES = ("allow", "forbid", "replace")

SHELL_IMAGE = "alpine:3"
HTTP_IMAGE = "curlimages/curl:8.6.0"
DEFAULT_TIMEOUT_SECONDS = 30

OUTPUT_CAP = 64_000
TRUNCATION_NOTICE = "\n...[truncated]"

JOB_NOT_FOUND = "Job not found"
TASK_NOT_FOUND = "Task not found"
NOT_RETRYABLE = "Only failed tasks can be retried"
INVALID_CRON = "Invalid cron expression"
CIRCULAR = "Circular dependency detected"
SHELL_DISABLED = "Shell actions are disabled"

LEASE_SECONDS = 30
SYNC_OVERLAP_SECONDS = 10
DEPTH_PER_WORKER = 20

# Display bands of the dashboard tiles: (from, colour); below the first: green, blue for workers.
PENDING_BANDS = ((1_000, "orange"), (10_000, "red"))
WORKER_BANDS = ((2, "green"), (7, "orange"), (10, "red"))
EXTRA_WORKER_BANDS = ((5, "orange"), (9, "red"))
