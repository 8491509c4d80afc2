import sys

from gradeloom.plans.cli import main

sys.exit(main())
