"""The word lists and dictionaries whose entries decide results."""

from __future__ import annotations

#: Fixed values. (fragment of a script address, kind); the first that matches decides.
TRACKERS = [
    ("google-analytics.com", "analytics"),
    ("googletagmanager.com", "analytics"),
    ("analytics.google.com", "analytics"),
    ("googlesyndication.com", "advertising"),
    ("doubleclick.net", "advertising"),
    ("connect.facebook.net", "advertising"),
    ("facebook.com/tr", "advertising"),
    ("hotjar.com", "analytics"),
    ("segment.com", "analytics"),
    ("mixpanel.com", "analytics"),
    ("amplitude.com", "analytics"),
    ("hubspot.com", "support"),
    ("hs-scripts.com", "support"),
    ("intercom.io", "support"),
    ("intercomcdn.com", "support"),
    ("drift.com", "support"),
    ("linkedin.com/insight", "advertising"),
    ("snap.licdn.com", "advertising"),
    ("analytics.twitter.com", "advertising"),
    ("static.ads-twitter.com", "advertising"),
    ("tiktok.com", "advertising"),
    ("clarity.ms", "analytics"),
    ("cdn.cookielaw.org", "unknown"),
    ("cookiebot.com", "unknown"),
    ("cookiefirst.com", "unknown"),
]

#: Fixed values. (fragment, consent tool); the first that matches decides.
CONSENT = [
    ("cookielaw.org", "OneTrust"),
    ("onetrust", "OneTrust"),
    ("cookiebot", "Cookiebot"),
    ("cookiefirst", "CookieFirst"),
    ("cookiepro", "CookiePro"),
    ("cookiehub", "CookieHub"),
    ("cookiyes", "CookieYes"),
    ("consent-banner", "custom"),
    ("gdpr-banner", "custom"),
    ("cookie-notice", "custom"),
    ("cookie-consent", "custom"),
    ("cookie-banner", "custom"),
    ("axeptio", "Axeptio"),
    ("trustarc", "TrustArc"),
    ("quantcast", "Quantcast"),
]

#: Fixed values. Words that keyword extraction skips.
STOP_WORDS = (
    "a an the and or but in on at to for of with by is are was were be been being have has had do does did will would "
    "could should may might shall can i me my we our you your he his she her it its they their this that these those "
    "from as into not no so if then than also just more about up out over all both each other some such only same very "
    "too us its which who any after s re"
).split()

#: Fixed values. Link texts that say nothing about their target.
GENERIC_LINK_TEXTS = ["click here", "here", "read more", "more", "link", "this", "learn more"]

#: Fixed values. Beginnings of a question heading, the space included.
QUESTION_PREFIXES = [
    "how ", "what ", "why ", "when ", "where ", "which ", "who ",
    "is ", "are ", "does ", "do ", "can ", "will ", "should ",
]

#: Fixed values. Elements whose text is not body text.
SKIPPED_TAGS = ["script", "style", "noscript", "template", "code", "pre"]

#: Fixed values. Where a sitemap is looked for after those that robots.txt names.
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap.xml.gz"]

CATEGORIES = ["performance", "accessibility", "best_practices", "seo", "gdpr", "keyword", "aeo"]
SEVERITIES = ["critical", "warning", "info"]
