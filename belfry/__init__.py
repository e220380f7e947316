"""Weekly schedule data as Spark jobs."""

from belfry.plans.extract_run import extract_run
from belfry.plans.fetch import fetch_bulletins
from belfry.plans.process import process_bulletins
from belfry.plans.verify import verify_churches

__all__ = ["extract_run", "fetch_bulletins", "process_bulletins", "verify_churches"]
