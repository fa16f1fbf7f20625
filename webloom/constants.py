"""Fixed values of the pipeline: limits, keyword tables, priorities and status domains."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Defaults; each can be set for a session as webloom.<lower-case name> or in the environment.
DEFAULTS = {
    "MAX_URL_LENGTH": 2048,
    "REQUEST_TIMEOUT_SECONDS": 15,
    "MAX_PAGES_PER_SCAN": 15,
    "MAX_CONTENT_SIZE_BYTES": 5_000_000,
    "CHUNK_SIZE_TOKENS": 600,
    "CHUNK_OVERLAP_TOKENS": 80,
    "LLM_MAX_OUTPUT_TOKENS": 2048,
    "LLM_MAX_CONTEXT_CHARS": 24_000,
}


def setting(spark: SparkSession, name: str) -> int:
    """A limit from the session, else the environment, else the default; what isn't a number is ignored."""
    for value in (spark.conf.get(f"webloom.{name.lower()}", None), os.environ.get(f"WEBLOOM_{name}")):
        try:
            return int(value)
        except (TypeError, ValueError):
            continue
    return DEFAULTS[name]


# Schemes that are recognised by name.
KNOWN_SCHEMES = ("http", "https", "ftp", "ftps", "file", "javascript", "data", "mailto", "tel", "ws", "wss", "vbscript", "about", "blob")

# Link keywords and their weights.
LINK_WEIGHTS = {
    "about": 100, "product": 95, "products": 95, "service": 95, "services": 95, "solution": 90, "solutions": 90, "pricing": 90,
    "customer": 85, "customers": 85, "case-study": 85, "case-studies": 85, "resources": 75, "blog": 70, "faq": 70, "contact": 65,
    "career": 60, "careers": 60, "terms": 50, "privacy": 50, "legal": 50, "cookie-policy": 50, "cookies": 50, "refund": 50,
}
# Path segments and file suffixes that are never crawled.
IGNORED_SEGMENTS = ("login", "log-in", "signin", "sign-in", "signup", "sign-up", "register", "cart", "checkout", "account", "search", "logout")
IGNORED_SUFFIXES = ("jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "pdf", "zip", "rar", "mp3", "mp4", "avi", "css", "js", "xml")

# Phrases of each page type; the order decides ties.
PAGE_TYPES = {
    "privacy_policy": ("privacy policy", "privacy notice", "data protection", "data privacy", "gdpr"),
    "cookie_policy": ("cookie policy", "cookies policy", "cookie notice", "manage cookies"),
    "refund_policy": ("refund policy", "return policy", "returns policy", "cancellation policy", "money back"),
    "terms": ("terms and conditions", "terms of service", "terms of use", "user agreement", "service agreement"),
    "case_study": ("case study", "case studies", "success story", "success stories", "customer story", "customer stories"),
    "pricing": ("pricing", "price", "prices", "plans", "subscription", "subscriptions", "packages"),
    "career": ("career", "careers", "jobs", "job openings", "open positions", "vacancies", "join us", "work with us"),
    "contact": ("contact", "contact us", "get in touch", "reach us", "talk to sales"),
    "about": ("about", "about us", "our company", "company profile", "who we are", "our story", "our team"),
    "faq": ("faq", "faqs", "frequently asked questions", "help center", "help centre", "knowledge base"),
    "blog": ("blog", "news", "articles", "insights", "resources", "press", "media"),
    "customer": ("customers", "clients", "testimonials", "reviews", "trusted by"),
    "product": ("product", "products", "platform", "solution", "solutions", "features", "capabilities"),
    "service": ("service", "services", "what we do", "offerings", "consulting"),
    "legal": ("legal", "compliance", "disclaimer", "accessibility statement"),
}
URL_WEIGHT = 4
SIGNAL_WEIGHTS = {"title": 3, "headings": 2, "meta": 1, "content": 1}

# Reading order of page types in a context; others come last.
PAGE_PRIORITY = (
    "homepage", "about", "product", "service", "pricing", "customer", "case_study", "use_case", "faq", "contact", "terms",
    "privacy_policy", "refund_policy", "cookie_policy", "legal", "career", "blog", "general", "unknown",
)
LAST_PRIORITY = 99

OK_STATUSES = ("success", "redirected")
RETRYABLE_STATUSES = ("timeout", "server_error", "failed")
RETRYABLE_ERRORS = ("website_unreachable", "timeout", "ai_extraction_failed", "internal_error")

NOT_AVAILABLE = "not_available"
CONFIDENCES = ("high", "medium", "low")
# Sourced fields of a company's intelligence, in output order.
REQUIRED_FIELDS = ("company_overview", "products_and_services")
OPTIONAL_FIELDS = (
    "pricing", "target_customers", "customer_journey", "use_cases", "blog_topics", "case_studies", "contact_details",
    "terms_summary", "privacy_summary", "refund_policy", "legal_indicators", "calls_to_action", "key_claims",
)
LEGAL_FLAGS = ("terms_available", "privacy_policy_available", "refund_policy_available", "cookie_policy_available")
