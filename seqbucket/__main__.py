import sys

from seqbucket.cli import main

sys.exit(main())
