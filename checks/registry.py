"""All registered queries."""

from checks import case_checks, cdn_checks, signature_checks, thread_checks

CHECKS = {**thread_checks.CHECKS, **signature_checks.CHECKS, **cdn_checks.CHECKS, **case_checks.CHECKS}
