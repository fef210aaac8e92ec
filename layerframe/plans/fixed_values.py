"""Values that have to be the same for results to be the same.

Fixed values: the items of a profile with the targets they appear under, the
content of blank items, the short names of items, the gateway entry and the
default scheme of server references.
"""

ITEM_TARGETS = {
    "mcp.json": ".mcp.json",
    "settings.json": ".claude/settings.json",
    "settings.local.json": ".claude/settings.local.json",
    "CLAUDE.md": "CLAUDE.md",
    "CLAUDE.local.md": "CLAUDE.local.md",
    "commands": ".claude/commands",
    "skills": ".claude/skills",
    "agents": ".claude/agents",
    "hooks": ".claude/hooks",
}

COMPONENT_ITEMS = {
    "mcp": "mcp.json",
    "settings": "settings.json",
    "local-settings": "settings.local.json",
    "claude": "CLAUDE.md",
    "local-claude": "CLAUDE.local.md",
    "commands": "commands",
    "skills": "skills",
    "agents": "agents",
    "hooks": "hooks",
}

BLANK_SERVERS = '{\n  "mcpServers": {}\n}\n'
BLANK_SETTINGS = '{\n  "permissions": {\n    "allow": [],\n    "deny": []\n  }\n}\n'
BLANK_JSON = "{}\n"
BLANK_TEXT = ""

SERVERS_FIELD = "mcpServers"
GATEWAY_NAME = "MCP_DOCKER"
GATEWAY_COMMAND = "docker"
GATEWAY_ARGS = ["mcp", "gateway", "run", "--profile"]

DEFAULT_SCHEME = "docker://"
