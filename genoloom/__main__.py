import sys

from genoloom.cli import main

sys.exit(main())
