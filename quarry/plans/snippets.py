"""Small C files on which the registered C queries run, with results worked out by hand from the counting rules."""

FILES = {
    "a/keep.c": """#include <stdio.h>
#include <stdbool.h>

int limit = 3;

extern int outside(int which);

/* too simple to keep */
bool flag(void) {
  return true;
}

char *label(void) { return "x"; }

int count(int a, unsigned char b) {
  int n = 0;
  if (a + n > limit) {
    n++;
  }
  for (int i = 0; i < a; i++) {
    n += -i;
  }
  return n;
}

int main(void) {
  if (flag()) {
    printf("%s", label());
  }
  return count(outside(2), 1) - 1;
}
""",
    "a/nomain.c": """#include <stdlib.h>

int twice(int x) {
  if (x - 1) {
    return x + x;
  }
  return 0;
}

float half(float y, bool z) {
  return z ? y / 2 : -y;
}

int sum(int *v, int n) {
  int s = 0;
  while (n > 0) {
    s = s + v[--n];
  }
  return s;
}
""",
    "b/foreign.c": "#include <unistd.h>\nint main(void) {\n  return 0;\n}\n",
    "b/short.c": "int one;\n\n",
}
CONFIG = "type=Int\nminTypeIfStmt=1\nminTypeArithmeticOperation=1\nminFileLoC=3\n"

#: Files for what those above don't have: macros and conditionals, calls of functions nobody defines, a main that is there, stubs that are declared.
MORE = {
    "c/macros.c": """#include <stdio.h>
#include <sys/types.h>
#include "own/util.h"
#include <stdio.h>
#define SIZE 4
#define EACH(i, n) for (int i = 0; i < (n); i++)
#define NAMED(x) made_##x
#if SIZE > 2
int NAMED(one)(int v) {
  EACH(k, SIZE) {
    v = v + k;
  }
  return v;
}
#else
int never(void) { return 0; }
#endif
int plain(int v) {
  return v;
}
""",
    "c/dead.c": """#include <stdbool.h>
bool known(int);
extern int outside(int);
unsigned int wide(void);
struct pair { int a; };
struct pair both(void);
int main(void) {
  if (known(1)) {
    return unheard(2) + outside(3);
  }
  both();
  return wide() + 1;
}
""",
    "c/hasmain.c": """extern int __VERIFIER_nondet_int(void);
int spare(int a, int b) {
  return a + b;
}
int used(void) {
  return __VERIFIER_nondet_int();
}
int main(void) {
  return used();
}
""",
}
