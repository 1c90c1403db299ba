"""Severity vocabulary and the words that imply a level."""

# Native level name -> standard level.
LEVEL_MAPPING = {
    "SEVERE": "ERROR",
    "ERROR": "ERROR",
    "FATAL": "ERROR",
    "CRITICAL": "ERROR",
    "MANDATORY": "WARN",
    "WARNING": "WARN",
    "WARN": "WARN",
    "APP": "INFO",
    "INFO": "INFO",
    "NOTICE": "INFO",
    "DEBUG": "DEBUG",
    "TRACE": "DEBUG",
    "VERBOSE": "DEBUG",
}

# Level words looked for behind a timestamp, in order of preference.
LEVEL_WORDS = [
    "SEVERE", "ERROR", "FATAL", "CRITICAL", "MANDATORY", "WARNING", "WARN",
    "APP", "INFO", "NOTICE", "DEBUG", "TRACE", "VERBOSE",
]

# A message without a level is an error when one of these is found in it.
IMPLICIT_ERROR = [
    r"\berror\b",
    r"\bexception\b",
    r"\bfailed\b",
    r"\bfailure\b",
    r"\bfatal\b",
    r"\bunable to\b",
    r"\bcannot\b",
    r"\bcan't\b",
    r"\bnot able to\b",
    r"\bdenied\b",
    r"\binvalid\b",
    r"\btimeout\b",
    r"\btimed out\b",
    r"\bconnection refused\b",
    r"\bstatus code\s*=\s*5\d{2}\b",
]

# Fixed values: ... and a warning when one of these is.
IMPLICIT_WARN = [
    r"\bwarning\b",
    r"\bwarn\b",
    r"\bdeprecated\b",
    r"\bretry(?:ing)?\b",
    r"\bretried\b",
    r"\breconnecting\b",
    r"\bskipping\b",
    r"\bnot found\b",
    r"\bmissing\b",
]
