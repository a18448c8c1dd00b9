"""Release policies, field classification and content predicates as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def _words(pattern: str) -> str:
    """An alternation between ASCII word edges, without regard to case."""
    return f"(?i){_B}(?:{pattern}){_E}"


# Fixed values below: patterns and tables must be these for results to agree.
INJECTION = (
    r"ignore (?:all |any )?(?:the )?(?:previous|prior|above|earlier) instructions?", r"disregard (?:all |any )?(?:the )?(?:previous|prior|above|earlier)",
    r"forget (?:all |any )?(?:the )?(?:previous|prior|above|your) instructions?", r"new instructions?:", r"override (?:your |the )?(?:system|previous) (?:prompt|instructions?)",
    r"you are (?:now |actually )?(?:an? )?(?:ai|agent|assistant|bot|llm)(?![A-Za-z0-9_])", r"act as (?:an? |if you (?:are|were) )", r"system\s*(?:prompt|message)\s*:", r"\[?\s*(?:system|assistant)\s*\]?\s*:",
    r"send (?:your|the|this|all) (?:data|information|details|tokens?|values?) to", r"(?:email|post|submit|upload) (?:this|the|your) (?:data|information|details) to",
    r"navigate to https?://[^\s]+\?[^\s]*(?:token|email|phone|aadhaar|card)", r"do not (?:tell|inform|mention (?:this|it) to) the user", r"don'?t (?:let|tell) the user know", r"keep this (?:secret|hidden) from the user",
)
NEGATIVE = "comment|comments|message|messages|description|feedback|query|queries|remark|remarks|review|reviews|note|notes|bio|about|instruction|instructions|search|post|body|reason"
FIELD_CATEGORIES = (
    (rf"{_B}e-?mail{_E}", "email"), (rf"{_B}(?:phone|mobile|{_B}tel{_E}|contact\s*(?:no|number)){_E}", "phone"), (rf"pass(?:word|wd|code)?{_E}|{_B}pwd{_E}", "password"),
    (rf"{_B}otp{_E}|one[- ]?time\s*(?:password|code)|verification\s*code", "otp"), (rf"card.?(?:no|num|number)?{_E}|{_B}cvv{_E}|{_B}cvc{_E}|credit\s*card|debit\s*card", "card"),
    (rf"aadh?aa?r|{_B}pan{_E}|passport|voter\s*id|driving\s*licen[cs]e|{_B}gstin{_E}|{_B}ssn{_E}", "id"), (rf"account.?(?:no|num|number)?{_E}|{_B}ifsc{_E}|{_B}upi{_E}|{_B}bank{_E}", "bank"),
    (rf"date of birth|{_B}dob{_E}|birth\s*date", "dob"), (rf"address|street|{_B}city{_E}|pin\s*code|postal\s*code|{_B}zip{_E}", "address"), (rf"user\s*name|{_B}user\s*id{_E}|{_B}login\s*id{_E}", "username"), (rf"{_B}name{_E}", "name"),
)
RELEASE = {
    "EMAIL": ("email",), "PHONE": ("phone",), "CC": ("card",), "CVV": ("card",), "PASSWORD": ("password",), "OTP": ("otp",), "SSN": ("id",), "AADHAAR": ("id",), "PAN": ("id",), "PASSPORT": ("id",), "VOTER_ID": ("id",),
    "DRIVING_LICENSE": ("id",), "GSTIN": ("id",), "BANK_ACCOUNT": ("bank", "id"), "UPI": ("bank", "id"), "DOB": ("dob",), "ADDRESS": ("address",), "PINCODE": ("address",), "NAME": ("name", "username"), "LOCATION": ("address", "name"), "IP": (), "SECRET": (),
}
FIELD_WORDS = {
    "PHONE": r"phone|mobile|telephone|tel|cell|cellphone|contact\s*(?:no|num|number)?|phone\s*(?:no|num|number)?|mobile\s*(?:no|num|number)?",
    "EMAIL": r"e-?mail|email\s*address|e-?mail\s*address|e-?mail\s*id|mail\s*id",
    "AADHAAR": r"aadh?aa?r|uid|unique\s*identification(?:\s*number)?|aadhar\s*(?:no|num|number)?|aadhaar\s*(?:no|num|number)?",
    "PAN": r"pan|pan\s*card|pan\s*(?:no|num|number)?|permanent\s*account\s*number",
    "UPI": r"upi|vpa|upi\s*id|virtual\s*payment\s*address",
    "CARD": r"card\s*number|card\s*no|credit\s*card|debit\s*card|cardholder|card\s*num",
    "CVV": r"cvv|cvc|csc|security\s*code|card\s*verification",
    "PASSWORD": r"password|passwd|pwd|passcode|pin",
    "DOB": r"dob|d\.o\.b|date\s*of\s*birth|birth\s*date|birthday",
    "BANK_ACCOUNT": r"bank\s*account|account\s*number|account\s*no|a/c\s*no|a/c\s*number|acct\s*no",
    "GSTIN": r"gst|gstin|gst\s*number|gst\s*no",
    "PASSPORT": r"passport|passport\s*(?:no|number)?",
    "VOTER_ID": r"voter\s*id|epic\s*(?:no|number)?|voter\s*card",
    "DRIVING_LICENSE": r"driving\s*licen[sc]e|dl\s*(?:no|number)?",
    "SSN": r"ssn|social\s*security(?:\s*number)?",
    "PINCODE": r"pincode|pin\s*code|postal\s*code|zip|zipcode|zip\s*code",
    "ADDRESS": r"address|street\s*address|residential\s*address|house\s*no|flat\s*no",
    "NAME": r"name|fullname|full\s*name|first\s*name|last\s*name|applicant\s*name|candidate\s*name|student\s*name|customer\s*name",
}
#: Input types and autocomplete values that say what a field is for, whatever its words.
EXPLICIT_TYPE = {"PHONE": ("tel",), "EMAIL": ("email",), "PASSWORD": ("password",), "DOB": ("date",)}
EXPLICIT_AUTO = {
    "PHONE": r"^tel$|^tel-", "EMAIL": r"^email$", "CARD": r"^cc-", "CVV": r"^cc-csc$", "PASSWORD": r"password", "DOB": r"^bday", "PINCODE": r"^postal-code$", "ADDRESS": r"^street-address$|^address-line", "NAME": r"^(?:name|given-name|family-name)$",
}
ALIASES = {"TEL": "PHONE", "MOBILE": "PHONE", "MAIL": "EMAIL", "AADHAR": "AADHAAR", "UID": "AADHAAR", "CC": "CARD", "CREDIT_CARD": "CARD"}
SENSITIVE_FIELD = rf"(?i)pass(?:word|wd|code)?|pwd|{_B}pin{_E}|otp|one.?time|cvv|cvc|csc|card.?(?:no|num)|cc-?(?:number|csc|exp|name)|expir|aadh?aa?r|{_B}pan{_E}|ssn|account.?(?:no|num)|ifsc|upi|dob|birth"
PERSONAL_AUTO = r"^(?:name|given-name|family-name|additional-name|email|tel|tel-national|street-address|address-line\d|postal-code|username)$"
IMAGE_TASK = rf"(?i){_B}(?:photo|image|picture|screenshot|scan(?:ned)?|logo|chart|diagram|graph|thumbnail|icon|colou?r|design|layout){_E}|what.{{0,15}}(?:look|see|show)"
HARD_RISK = "buy|purchase|checkout|check out|place order|pay|payment|confirm order|submit payment|delete|remove|unsubscribe|cancel subscription|send (?:message|email|dm)|transfer funds|wire transfer"
SOFT_RISK = "follow|unfollow|retweet|repost|like|favorite|tweet|post tweet"
TRANSIENT = r"(?i)back/forward cache|message channel is closed|message port closed|could not establish connection|receiving end does not exist|frame with ID .* does not exist|no frame with id"


def looks_like_injection(text: Column) -> Column:
    """Eight characters or more that try to instruct the agent."""
    return F.coalesce((F.length(text) >= 8) & text.rlike("(?i)" + "|".join(INJECTION)), F.lit(False))


def normalize_category(type_: Column) -> Column:
    t = F.upper(F.trim(type_))
    return F.coalesce(F.create_map(*[F.lit(x) for p in ALIASES.items() for x in p])[t], t)


def field_category(label: Column) -> Column:
    """What a label asks for, first rule wins; unknown where it asks for free text."""
    out = F.when(F.coalesce(label, F.lit("")).rlike(_words(NEGATIVE)), "unknown")
    for pattern, category in FIELD_CATEGORIES:
        out = out.when(label.rlike("(?i)" + pattern), category)
    return out.otherwise("unknown")


def field_classes(meta: dict[str, Column]) -> Column:
    """All categories a field asks for: explicit type or autocomplete beats the words, free-text words veto the rest (but passwords)."""
    get = lambda k: F.lower(F.coalesce(meta.get(k, F.lit("")), F.lit("")))
    said = F.concat_ws(" ", *[get(k) for k in ("label_text", "aria_label", "placeholder", "name", "id")])
    free = said.rlike(_words(NEGATIVE))
    kind, auto = get("type"), get("autocomplete")
    each = []
    for category, words in FIELD_WORDS.items():
        by_words = said.rlike(_words(words))
        hit = by_words if category == "PASSWORD" else by_words & ~free
        if category in EXPLICIT_TYPE:
            hit = hit | kind.isin(*EXPLICIT_TYPE[category])
        if category in EXPLICIT_AUTO:
            hit = hit | auto.rlike(EXPLICIT_AUTO[category])
        each.append(F.when(hit, F.lit(category)))
    return F.array_compact(F.array(*each))


def data_allowed(types: Column, classes: Column) -> Column:
    """Every type of the data is one the field asks for."""
    return F.size(F.array_except(F.transform(types, normalize_category), classes)) == 0


def field_kind(type_: Column, autocomplete: Column, words: Column) -> Column:
    """Sensitivity of a field; null where it is plain."""
    auto = F.element_at(F.split(F.lower(F.coalesce(autocomplete, F.lit(""))), r"\s+"), -1)
    secret = auto.isin("current-password", "new-password", "one-time-code", "cc-number", "cc-csc", "cc-exp", "cc-exp-month", "cc-exp-year", "cc-name", "bday", "bday-day", "bday-month", "bday-year")
    of_auto = F.when(auto.startswith("cc"), "CARD").when(auto == "one-time-code", "OTP").when(auto.contains("password"), "PASSWORD").otherwise("DOB")
    kind = F.lower(F.coalesce(type_, F.lit("")))
    return (
        F.when(kind == "password", "PASSWORD").when(secret, of_auto).when(words.rlike(SENSITIVE_FIELD), "SENSITIVE_FIELD").when(auto.rlike(PERSONAL_AUTO) | kind.isin("email", "tel"), "PERSONAL_FIELD")
    )


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#:]+)", 1))


def web_origin(url: Column) -> Column:
    """Scheme, host and port in lower case; null for anything but http and https."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^(https?://[^/?#]+)", 1)), F.lit(""))


def origin_allowed(destination: Column, source: Column, allowed: Column) -> Column:
    """Web addresses only: an allowed origin, host or parent domain, this machine, or the origin the value came from."""
    to, host = web_origin(destination), _host(destination)
    listed = F.exists(F.coalesce(allowed, F.array().cast("array<string>")), lambda a: F.when(web_origin(a).isNotNull(), web_origin(a) == to).otherwise((host == F.lower(a)) | host.endswith(F.concat(F.lit("."), F.lower(a)))))
    local = host.isin("localhost", "127.0.0.1", "[::1]") | host.endswith(".local")
    same = F.coalesce((source != "user_prompt") & (web_origin(source) == to), F.lit(False))
    return F.coalesce(to.isNotNull() & (F.coalesce(listed, F.lit(False)) | local | same), F.lit(False))


def release_decision(has_provenance: Column, origin_ok: Column, field_known: Column, field_ok: Column, approved: Column) -> Column:
    """ALLOW, USER_DECISION or BLOCK: approval overrides origin and field, never missing provenance."""
    return F.when(~has_provenance, "BLOCK").when(approved, "USER_DECISION").when(origin_ok & field_known & field_ok, "ALLOW").otherwise("BLOCK")


def release_ok(type_: Column, category: Column, token_origin: Column, current: Column) -> Column:
    """The type's own fields only, on the origin it came from; types outside the table are not governed."""
    matrix = F.create_map(*[x for k, v in RELEASE.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]).cast("array<string>"))])
    allowed = matrix[type_]
    return allowed.isNull() | (F.array_contains(allowed, category) & (token_origin.isNull() | (token_origin == current)))


def needs_screenshot(canvas: Column, prompt: Column, confidence: Column) -> Column:
    """Why an image is sent, or null."""
    return F.when(canvas, "canvas").when(F.coalesce(prompt, F.lit("")).rlike(IMAGE_TASK), "visual_task").when(F.coalesce(confidence, F.lit(1.0)) < 0.35, "low_confidence")


def risky(label: Column, role: Column) -> Column:
    """Hard words anywhere; soft words only on a short button or link."""
    return F.coalesce(label.rlike(_words(HARD_RISK)) | (role.isin("button", "link") & (F.length(label) <= 24) & label.rlike(_words(SOFT_RISK))), F.lit(False))


def device_tier(cores: Column, memory: Column) -> Column:
    n = F.coalesce(cores, F.lit(4))
    return F.when((n <= 2) | F.coalesce(memory <= 2, F.lit(False)), "eco").when((n >= 8) & (memory.isNull() | (memory >= 8)), "max").otherwise("balanced")


def transient_error(message: Column) -> Column:
    return F.coalesce(message.rlike(TRANSIENT), F.lit(False))


def visible(display: Column, visibility: Column, opacity: Column, font: Column, fg: Column, bg: Column, bg_alpha: Column) -> Column:
    """Rendered, opaque enough, large enough, and not in the colour of its ground."""
    return (display != "none") & (visibility != "hidden") & (opacity > 0.05) & (font >= 2) & ~((fg == bg) & (bg_alpha > 0.5))


#: Addresses and words of pages that ask to sign in, pages of widgets and words that ask to prove one is human,
#: the longest text of a thin page and the most other fields of a sign-in gate.
LOGIN_URL = r"(?i)/(?:i/flow/login|login|account/login|signin|sign[_-]?in|auth)(?:/|\?|#|$)"
LOGIN_CTA = r"(?i)log in|sign up|see what.?s happening"
CAPTCHA_WIDGET, CAPTCHA_HELPER = r"(?i)recaptcha|hcaptcha|arkoselabs|funcaptcha|challenges\.cloudflare\.com", r"(?i)recaptcha/api2/(?:aframe|anchor)"
CAPTCHA_TITLE = r"(?i)just a moment|attention required"
CAPTCHA_TEXT = r"(?i)verify you are human|i'?m not a robot|security check|checking your browser|prove you'?re human|rate limit exceeded|unusual traffic from your computer network"
THIN_PAGE, GATE_FIELDS = 1_800, 2


def page_walls(nodes: DataFrame, page: str, url: str, title: str) -> DataFrame:
    """(page, login_wall, captcha) from a page's nodes (node_role, text, label, placeholder, src, rect) with its address and title.

    A sign-in wall is an address that says so, a timeline without posts that asks to sign up, or a thin page with a
    password field and at most two others.
    """
    t, words = F.coalesce("text", F.lit("")), F.lower(F.concat_ws(" ", "label", "placeholder"))
    field = F.col("node_role").isin("textbox", "combobox", "password")
    secret = (F.col("node_role") == "password") | field & words.rlike("password|passwd|pwd")
    n = lambda c: F.count(F.when(c, 1))
    widget = F.col("src").rlike(CAPTCHA_WIDGET) & ~F.col("src").rlike(CAPTCHA_HELPER) & (F.col("rect.w") > 4) & (F.col("rect.h") > 4)
    by = nodes.groupBy(page).agg(F.max(url).alias("u"), F.max(title).alias("ti"), F.sum(F.length(t)).alias("size"), n(secret).alias("pw"), n(field & ~secret).alias("others"), n(F.col("node_role") == "article").alias("posts"), n(t.rlike(LOGIN_CTA)).alias("cta"), n(widget).alias("widgets"), n(t.rlike(CAPTCHA_TEXT)).alias("asks"))
    feed = F.coalesce(F.col("u").rlike(r"(?i)^https?://(?:[^/]*\.)?(?:x|twitter)\.com(?:[/:?#]|$)"), F.lit(False)) & (F.col("posts") == 0) & (F.col("cta") > 0)
    gate = (F.col("pw") > 0) & (F.col("size") < THIN_PAGE) & (F.col("others") <= GATE_FIELDS)
    login = F.coalesce(F.col("u").rlike(LOGIN_URL), F.lit(False)) | feed | gate
    captcha = (F.col("widgets") > 0) | (F.col("asks") > 0) | F.coalesce(F.col("ti").rlike(CAPTCHA_TITLE), F.lit(False))
    return by.select(page, login.alias("login_wall"), captcha.alias("captcha"))


#: Roles of input types and of elements, and the elements and roles a person can act on.
INPUT_ROLES = {"submit": "button", "button": "button", "image": "button", "reset": "button", "checkbox": "checkbox", "radio": "radio", "file": "file", "range": "slider", "color": "button"}
TAG_ROLES = {"a": "link", "button": "button", "textarea": "textbox", "select": "combobox", "article": "article", "h1": "heading", "h2": "heading", "h3": "heading", "li": "listitem", "p": "paragraph", "img": "image", "nav": "navigation", "dialog": "dialog"}
ACTIVE_TAGS = ("a", "button", "input", "textarea", "select")
ACTIVE_ROLES = ("button", "link", "menuitem", "tab", "checkbox", "textbox")


def element_role(tag: Column, type_: Column, role: Column, editable: Column, classes: Column) -> Column:
    """The role of an element: its own, else by its input type, by being editable, by an alert's classes, by its tag."""
    name = F.lower(tag)
    of = lambda values, key: F.create_map(*[F.lit(x) for p in values.items() for x in p])[key]
    alert = F.coalesce(classes.rlike("(?i)toast|alert|error|invalid|destructive"), F.lit(False))
    return (
        F.when(F.coalesce(role, F.lit("")) != "", role).when(name == "input", F.coalesce(of(INPUT_ROLES, F.lower(F.coalesce(type_, F.lit("text")))), F.lit("textbox"))).when(F.coalesce(editable, F.lit(False)), "textbox").when(alert, "alert").otherwise(F.coalesce(of(TAG_ROLES, name), name))
    )


def interactive(tag: Column, role: Column, editable: Column, handler: Column, tab_index: Column) -> Column:
    """Whether a person can act on an element."""
    return F.lower(tag).isin(*ACTIVE_TAGS) | F.coalesce(role.isin(*ACTIVE_ROLES), F.lit(False)) | F.coalesce(editable, F.lit(False)) | F.coalesce(handler, F.lit(False)) | F.coalesce(tab_index >= 0, F.lit(False))
