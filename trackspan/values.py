"""Fixed values. Results depend on these, so they are stated once, as plain text."""

# --- fixed values -----------------------------------------------------------

RESOLVED_STATUSES = ("Done", "Closed", "Resolved", "Completed")
ACTIVE_STATUSES = ("In Progress", "Active", "Development")
PENDING_STATUSES = ("To Do", "Open", "New", "Backlog")

PRIORITY_SCORES = {"Critical": 5, "High": 4, "Medium": 3, "Low": 2, "Lowest": 1}

DEFAULT_ASSIGNEE = "Unassigned"
DEFAULT_PRIORITY = "None"
DEFAULT_REPORTER = "Unknown"
DEFAULT_EPIC_STATUS = "Unknown"

NEW_TICKET_TYPE = "Task"
NEW_TICKET_PRIORITY = "Medium"
NEW_TICKET_STATUS = "To Do"
EPIC_TYPE = "Epic"

STANDARD_EPIC_NAME = "Bugs and Configuration"
DEFAULT_LINK_TYPE = "Relates"

EPIC_LINK_FIELD = "customfield_10014"
STORY_POINTS_FIELD = "customfield_10016"
STORY_POINTS_NAMES = ("story points", "story point estimate", "story point estimates")

BOT_NAME_WORDS = ("automation", "system", "slack", "teams", "trello", "opsgenie", "jira")

ACCOUNT_ID_PREFIXES = {
    "tool": ("5d8b8c8e", "557058:", "712020:"),
    "search": ("5d", "557058:", "712020:"),
}
TICKET_KEY_PATTERN = r"(?i)^[A-Z]+-\d+$"

LOOKBACK_DAYS = 180
MAX_INPUT_CHARS = 50_000
MIN_TITLE_RATIO = 0.5
MIN_TICKETS_FOR_RATE = 3
SHOWN_TURNS = 50
SHOWN_USERS = 10
LISTED_USERS = 5

ASSIGNEE_METRICS = ("avg_resolution_time", "resolution_rate", "resolved_tickets", "total_tickets")
DRILLDOWN_COLUMNS = (
    "key", "summary", "project", "status", "status_category", "priority", "created", "updated",
)

# --- end of fixed values ----------------------------------------------------
