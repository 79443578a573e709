"""spark-submit entry point: ``spark-submit --py-files lendscope.zip lendscope_job.py <command> ...``."""

import sys

from lendscope.cli import main

if __name__ == "__main__":
    sys.exit(main())
