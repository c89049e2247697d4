import sys

from .plans.engine import main

sys.exit(main())
