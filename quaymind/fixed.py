"""Fixed values.

Texts, labels, formats and patterns whose exact value the results depend
on, kept together in natural order.  Code refers to them by name; the
format templates are filled with Column values by :func:`fill`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: routing and escalation labels / replies
GREETING_REPLY = "How can I help you today?"
TICKET_LOGGED = "TICKET_LOGGED"
LOG_TICKET = "log_ticket"
LOG_TICKET_SPELLINGS = ["LOGGING_TICKET", "LOG_TICKET"]
NO_MATCH = "NO_MATCH"
PRODUCT_LABEL = "PRODUCT_ENQUIRE"
STORE_LOCATOR = "STORE_LOCATOR"
STORE_NEEDS_LOCATION = "STORE_LOCATOR_NEEDS_LOCATION"
FAQ = "FAQ"
EMOTIONS = ["frustrated", "worried", "confused", "sad"]

# fixed values: request validation messages
EMPTY_QUESTION = "Question cannot be empty."
HISTORY_NOT_LIST = "conversation_history must be a list."

# fixed values: stores
CLOSED_MARKER = "Temporarily Closed"
STORE_LINE = "- {name}: {location} | Hours: {hours} | WhatsApp: {link}"
STORE_BLOCK = "📍 {name}\n🏢 {location}\n🕐 {hours}\n💬 {link}"
STORE_BLOCK_SEP = "\n\n"

# fixed values: catalog sentence, product links and result cards
SENTENCE = ("Vendor {vendor} offers a {product_type} with handle {handle}, color {color}, spec {spec}, "
            "condition {condition}, tenure {tenure}, priced at {price}.")
PRODUCT_LINK = "https://{domain}/products/{handle}"
VARIANT_SUFFIX = "?variant={variant_id}"
CURRENCY = "RM"
UNKNOWN_MODEL = "Unknown model"
FLASH_DEAL_SUFFIX = "-flash-deal"
EMPTY_FIELD = "-"
VALUE_SEP = " / "
CARD = "{n}. {title}\nFrom {price}\nOptions: {options}\nCondition: {conditions}\nColor: {colors}\nView options: {link}"
CARD_SEP = "\n\n"
NO_MATCH_RANGE = "No matches in range {lo} to {hi}."
NO_MATCH_UNDER = "No matches under {hi}."
NO_MATCH_ABOVE = "No matches above {lo}."
NO_MATCH_ANY = "No matches after filtering."
PRICE_LINE_BOTH = "{lo} to {hi}"
PRICE_LINE_MIN = "min {lo}"
PRICE_LINE_MAX = "max {hi}"
PRICE_LINE_NONE = "None"

# fixed values: documents and conversations
SECTION_MARKER = "## "
GENERAL_SECTION = "General"
HEADING_1 = "Heading 1"
HEADING_2 = "Heading 2"
LIST_STYLE = "List Paragraph"
HEADING_2_PREFIX = "\n### "
LIST_PREFIX = "- "
ALL_SECTIONS_SEP = "\n\n---\n\n"
CUSTOMER_PREFIX = "Customer: "
AGENT_PREFIX = "Agent: "
MEMORY_PAIR = "User: {user}\nBot: {bot}"
DEFAULT_SCHEMA = "public"

# fixed values: fingerprints
FINGERPRINT_COLS = ["product_id", "variant_id", "vendor", "product_type", "handle", "color", "spec",
                    "condition", "tenure", "price"]
FINGERPRINT_SEP = "|"
FINGERPRINT_NULL = "None"

# fixed values: characters a workbook cell cannot hold
CONTROL_CHARS = "[\\x00-\\x08\\x0b-\\x0c\\x0e-\\x1f]"

_SLOT = re.compile(r"\{(\w+)\}")


def fill(template: str, **values: Column) -> Column:
    """A template with ``{name}`` slots as one ``concat`` of literals and columns."""
    parts: list[Column] = []
    pos = 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(values[m.group(1)])
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if len(parts) > 1 else parts[0]
