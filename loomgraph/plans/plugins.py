"""Rules of frameworks and tools, as rows.

Fixed values: names, activation, configuration files and packages are those of the
tools themselves. `Rules` holds the tables of one session: the built-in rows, and those
of plugins that a user registers, which replace a built-in plugin of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: name, activation (file, dep, file/dep or base), packages (name, for development, optional), configuration files
_RULES = [
    ("graphql", "dep", [("graphql", False, False)], ["codegen.yml", "codegen.ts", ".graphqlrc", ".graphqlrc.yml", "graphql.config.js"]),
    ("apollo", "dep", [("@apollo/client", False, False), ("@apollo/server", False, True)], ["apollo.config.js", "apollo.config.ts", "apollo.config.cjs"]),
    ("database", "base", [("@prisma/client", False, True), ("drizzle-orm", False, True), ("typeorm", False, True)], ["prisma/schema.prisma", "drizzle.config.ts", "drizzle.config.js", "ormconfig.json", "ormconfig.js"]),
    ("prisma", "file/dep", [("@prisma/client", False, False), ("prisma", True, False)], ["schema.prisma", "prisma.config.ts"]),
    ("drizzle", "file/dep", [("drizzle-orm", False, False), ("drizzle-kit", True, False)], ["drizzle.config.ts", "drizzle.config.js", "drizzle.config.mjs"]),
    ("mongoose", "dep", [("mongoose", False, False)], ["mongoose.config.js"]),
    ("supabase", "dep", [("@supabase/supabase-js", False, False)], ["supabase.config.js", "supabase.config.ts", "config.toml", "supabase.ts"]),
    ("firebase", "file/dep", [("firebase", False, False)], ["firebase.json", ".firebaserc", "firebase.config.js"]),
    ("clerk", "dep", [("@clerk/nextjs", False, True), ("@clerk/clerk-react", False, True)], ["clerk.config.js", "clerk.config.ts", "middleware.ts"]),
    ("trpc", "dep", [("@trpc/server", False, False), ("@trpc/client", False, False)], ["trpc.config.ts"]),
    ("nuxt", "file", [("nuxt", False, False)], ["nuxt.config.ts", "nuxt.config.js"]),
    ("remix", "file", [("@remix-run/react", False, False), ("@remix-run/node", False, True)], ["remix.config.js", "remix.config.ts", "remix.config.mjs"]),
    ("sveltekit", "file", [("@sveltejs/kit", False, False), ("svelte", False, False)], ["svelte.config.js", "svelte.config.ts"]),
    ("astro", "file", [("astro", False, False)], ["astro.config.mjs", "astro.config.ts", "astro.config.js"]),
    ("vitepress", "file/dep", [("vitepress", True, False)], [".vitepress/config.ts"]),
    ("gatsby", "file", [("gatsby", False, False)], ["gatsby-config.js", "gatsby-config.ts", "gatsby-node.js", "gatsby-browser.js"]),
    ("redwood", "file", [("@redwoodjs/core", True, False)], ["redwood.toml"]),
    ("next", "file", [("next", False, False)], ["next.config.js", "next.config.mjs", "next.config.ts", "next.config.cjs"]),
    ("react", "dep", [("react", False, False), ("react-dom", False, False)], ["react.config.js"]),
    ("vue", "dep", [("vue", False, False)], ["vue.config.js", "vue.config.ts", "vue.config.mjs", "vue.config.cjs"]),
    ("svelte", "dep", [("svelte", False, False)], ["svelte.config.js", "svelte.config.ts"]),
    ("angular", "dep", [("@angular/core", False, False), ("@angular/common", False, False)], ["angular.json", ".angular-cli.json"]),
    ("preact", "dep", [("preact", False, False)], ["preact.config.js"]),
    ("solid", "dep", [("solid-js", False, False)], ["solid.config.js", "solid.config.ts", "app.config.ts"]),
    ("qwik", "dep", [("@builder.io/qwik", False, False)], ["qwik.config.ts", "qwik.config.js"]),
    ("lit", "dep", [("lit", False, False)], ["lit.config.js"]),
    ("vite", "file", [("vite", True, False)], ["vite.config.ts", "vite.config.js", "vite.config.mjs", "vite.config.cjs", "vite.config.mts"]),
    ("esbuild", "file", [("esbuild", True, False)], ["esbuild.config.js", "esbuild.config.mjs", "esbuild.config.ts"]),
    ("rollup", "file", [("rollup", True, False)], ["rollup.config.js", "rollup.config.mjs", "rollup.config.ts"]),
    ("webpack", "file", [("webpack", True, False)], ["webpack.config.js", "webpack.config.ts", "webpack.config.cjs", "webpack.config.mjs"]),
    ("parcel", "file", [("parcel", True, False)], [".parcelrc", "parcel.config.js"]),
    ("turbo", "file", [("turbo", True, False)], ["turbo.json"]),
    ("nx", "file", [("nx", True, False)], ["nx.json", "workspace.json"]),
    ("tailwind", "file", [("tailwindcss", True, False)], ["tailwind.config.js", "tailwind.config.ts", "tailwind.config.cjs", "tailwind.config.mjs"]),
    ("postcss", "file", [("postcss", True, False)], ["postcss.config.js", "postcss.config.cjs", "postcss.config.mjs", "postcss.config.ts", ".postcssrc"]),
    ("unocss", "file", [("unocss", True, False)], ["uno.config.ts", "unocss.config.ts"]),
    ("stylelint", "file", [("stylelint", True, False)], [".stylelintrc", "stylelint.config.js"]),
    ("eslint", "file", [("eslint", True, False)], ["eslint.config.js", ".eslintrc.js"]),
    ("prettier", "file", [("prettier", True, False)], [".prettierrc", "prettier.config.js"]),
    ("biome", "file", [("@biomejs/biome", True, False)], ["biome.json"]),
    ("oxlint", "file", [("oxlint", True, False)], [".oxlintrc.json"]),
    ("husky", "file", [("husky", True, False)], [".huskyrc"]),
    ("lint-staged", "file", [("lint-staged", True, False)], [".lintstagedrc"]),
    ("commitlint", "file", [("@commitlint/cli", True, False)], ["commitlint.config.js"]),
    ("changeset", "file", [("@changesets/cli", True, False)], [".changeset/config.json"]),
    ("babel", "file", [("@babel/core", True, False)], ["babel.config.js", ".babelrc"]),
    ("swc", "file", [("@swc/core", True, False)], [".swcrc"]),
    ("jest", "file", [("jest", True, False)], ["jest.config.js"]),
    ("vitest", "file", [("vitest", True, False)], ["vitest.config.ts", "vitest.config.js"]),
    ("playwright", "file", [("@playwright/test", True, False)], ["playwright.config.ts"]),
    ("cypress", "file", [("cypress", True, False)], ["cypress.config.ts"]),
    ("storybook", "file", [("storybook", True, False)], [".storybook/main.ts"]),
    ("msw", "dep", [("msw", True, False)], []),
    ("github-actions", "file", [], []),
    ("docker", "file", [], []),
    ("terraform", "file", [], []),
    ("editorconfig", "file", [], []),
    ("nvm", "file", [], []),
    ("volta", "dep", [], []),
    ("dotenv", "file", [], []),
    ("pnpm", "file", [], []),
    ("yarn", "file", [], []),
    ("bun", "file", [], []),
    ("swiper", "dep", [("swiper", False, False)], []),
    ("quill", "dep", [("quill", False, False)], []),
    ("envelop", "dep", [("@envelop/core", False, False)], []),
    ("hono", "dep", [("hono", False, False)], []),
    ("express", "dep", [("express", False, False)], []),
    ("fastify", "dep", [("fastify", False, False)], []),
    ("nestjs", "dep", [("@nestjs/core", False, False)], []),
    ("koa", "dep", [("koa", False, False)], []),
    ("elysia", "dep", [("elysia", False, False)], []),
    ("socket.io", "dep", [("socket.io", False, False)], []),
    ("typescript", "file", [], ["tsconfig.json", "jsconfig.json"]),
    ("grammy", "dep", [("grammy", False, False)], []),
    ("hapi", "dep", [("@hapi/hapi", False, False)], []),
    ("rtlcss", "file", [("rtlcss", True, False)], [".rtlcssrc"]),
    ("ckeditor5-engine", "dep", [("@ckeditor/ckeditor5-engine", False, False)], []),
    ("nitro-modules", "dep", [("react-native-nitro-modules", False, False)], []),
    ("antd", "dep", [("antd", False, False)], []),
    ("mui", "dep", [("@mui/material", False, False), ("@emotion/react", False, False)], []),
    ("shadcn", "file", [], ["components.json"]),
    ("radix-ui", "dep", [], []),
    ("chakra-ui", "dep", [("@chakra-ui/react", False, False)], []),
    ("framer-motion", "dep", [("framer-motion", False, False)], []),
    ("gsap", "dep", [("gsap", False, False)], []),
    ("zod", "dep", [("zod", False, False)], []),
    ("yup", "dep", [("yup", False, False)], []),
    ("valibot", "dep", [("valibot", False, False)], []),
    ("i18next", "dep", [("i18next", False, False)], []),
    ("vue-i18n", "dep", [("vue-i18n", False, False)], []),
    ("sentry", "dep", [], []),
    ("opentelemetry", "dep", [], []),
    ("redux", "dep", [("@reduxjs/toolkit", False, False), ("react-redux", False, False)], ["redux.config.js"]),
    ("zustand", "dep", [("zustand", False, False)], ["zustand.config.js"]),
    ("jotai", "dep", [("jotai", False, False)], ["jotai.config.js"]),
    ("recoil", "dep", [("recoil", False, False)], ["recoil.config.js"]),
    ("mobx", "dep", [("mobx", False, False), ("mobx-react-lite", False, True)], ["mobx.config.js"]),
    ("pinia", "dep", [("pinia", False, False)], ["pinia.config.js"]),
    ("tanstack-query", "dep", [("@tanstack/react-query", False, False)], ["query.config.js"]),
    ("react-router", "dep", [("react-router-dom", False, False)], ["router.config.js"]),
    ("tanstack-router", "dep", [("@tanstack/react-router", False, False)], ["tsr.config.json"]),
    ("vue-router", "dep", [("vue-router", False, False)], ["router.config.js"]),
    ("socketio", "dep", [("socket.io", False, False)], ["socket.config.js"]),
]

# fixed values: paths that a framework loads by itself
_ROUTES = [
    ("nuxt", r"/pages/"),
    ("nuxt", r"/server/(api|routes|middleware)/"),
    ("nuxt", r"/components/.*\.vue$"),
    ("remix", r"/app/routes/"),
    ("remix", r"/app/root\.(tsx|jsx)$"),
    ("sveltekit", r"/\+(page|layout|server)(\.server)?\.(ts|js|svelte)$"),
    ("astro", r"/src/pages/.*\.(astro|ts|js)$"),
    ("vitepress", r"/\.vitepress/"),
    ("gatsby", r"/src/(pages|templates)/"),
    ("redwood", r"/web/src/pages/"),
    ("redwood", r"/api/src/functions/"),
    ("next", r"/app/(.*/)?(page|layout|route|loading|error|not-found)\.(tsx|ts|jsx|js)$"),
    ("next", r"/pages/.*\.(tsx|ts|jsx|js)$"),
]
# fixed values: exports that a framework calls by name
_CONTRACTS = {
    "nuxt": "default",
    "remix": "default loader action meta links",
    "sveltekit": "load actions GET POST PUT PATCH DELETE",
    "astro": "default getStaticPaths",
    "gatsby": "default getServerData config",
    "next": "default generateStaticParams generateMetadata metadata getServerSideProps getStaticProps getStaticPaths",
    "trpc": "router procedure createTRPCRouter",
    "react-router": "default Route Routes Link useNavigate useParams useLocation",
}
# fixed values: text that marks a file as a framework's entry
_NEEDLES = [
    ("apollo", "ApolloClient"),
    ("apollo", "ApolloServer"),
    ("prisma", "new PrismaClient()"),
    ("drizzle", "drizzle("),
    ("mongoose", "mongoose.model("),
    ("supabase", "createClient"),
    ("firebase", "initializeApp"),
    ("redux", "createSlice("),
    ("redux", "configureStore("),
    ("zustand", "create("),
    ("jotai", "atom("),
    ("socketio", "io.on("),
    ("socketio", "socket.on("),
    ("antd", "from \"antd\""),
    ("antd", "from 'antd'"),
    ("mui", "@mui/material"),
    ("express", "express()"),
    ("express", "express.Router()"),
    ("fastify", "Fastify("),
    ("nestjs", "@Module"),
    ("nestjs", "@Controller"),
    ("nestjs", "@Injectable"),
    ("hono", "new Hono()"),
    ("koa", "new Koa()"),
    ("elysia", "new Elysia()"),
    ("swiper", "new Swiper("),
    ("quill", "new Quill("),
    ("envelop", "useEnvelop("),
]
# fixed values: folders that a tool loads by itself, and its package
_FOLDERS = [("vitepress", ".vitepress", "vitepress")]
# fixed values: configuration to start with, for tools that have none yet
_TEMPLATES = [
    ("tailwind", "tailwind.config.js", "module.exports = { content: [], theme: { extend: {} }, plugins: [] };\n"),
    ("prettier", ".prettierrc", "{}\n"),
    ("eslint", "eslint.config.js", "export default [];\n"),
    ("typescript", "tsconfig.json", '{ "compilerOptions": { "strict": true } }\n'),
]
# fixed values: programs of scripts and the packages they come with, where the names differ
_PROGRAMS = {"tsc": "typescript", "ng": "@angular/cli", "vue-cli-service": "@vue/cli-service", "playwright": "@playwright/test", "biome": "@biomejs/biome", "changeset": "@changesets/cli", "commitlint": "@commitlint/cli", "babel": "@babel/cli", "swc": "@swc/cli", "storybook": "storybook", "prisma": "prisma", "next": "next", "remix": "@remix-run/dev", "nest": "@nestjs/cli", "tsr": "@tanstack/router-cli", "drizzle-kit": "drizzle-kit", "svelte-kit": "@sveltejs/kit", "expo": "expo", "vsce": "@vscode/vsce", "lerna": "lerna"}
# fixed values: packages whose names are imitated
POPULAR = "react react-dom lodash express axios vue next typescript webpack vite eslint prettier jest chalk commander moment dayjs rxjs redux zod uuid dotenv cors debug async request underscore jquery".split()
# fixed values: older tools, what replaces them, and why
MIGRATIONS = [
    ("webpack", "vite", "it builds and reloads faster"),
    ("jest", "vitest", "it runs modules as they are and shares the bundler's configuration"),
    ("moment", "dayjs", "it has the same interface at a fraction of the size"),
    ("axios", "fetch", "the platform has it"),
    ("ts-node", "tsx", "it is faster and runs modules as they are"),
    ("eslint-plugin-prettier", "eslint-config-prettier", "formatting as a lint rule is slow"),
]


_SCHEMAS = {
    "activations": "plugin string, activation string",
    "packages": "plugin string, package string, is_dev boolean, is_optional boolean",
    "config_files": "plugin string, file_name string",
    "routes": "plugin string, regex string",
    "contracts": "plugin string, contract string",
    "needles": "plugin string, needle string",
}


def _built_in() -> dict[str, list[tuple]]:
    return {
        "activations": [(n, a) for n, a, _, _ in _RULES],
        "packages": [(n, *p) for n, _, ps, _ in _RULES for p in ps],
        "config_files": [(n, c) for n, _, _, cs in _RULES for c in cs],
        "routes": [(p, "(^|/)" + r.removeprefix("/") if r.startswith("/") else r) for p, r in _ROUTES],
        "contracts": [(n, c) for n, *_ in _RULES for c in _CONTRACTS.get(n, "default").split()],
        "needles": _NEEDLES,
    }


class Rules:
    """The rule tables of a session. ``registered``: rows of `define`, in order; the last of a name counts."""

    def __init__(self, spark: SparkSession, registered: list[dict] | None = None):
        self.spark, self.tables, self.protected = spark, _built_in(), []
        for one in registered or []:
            self.register(one)

    def register(self, plugin: dict) -> None:
        name = plugin["activations"][0][0]
        for table, rows in self.tables.items():
            self.tables[table] = [r for r in rows if r[0] != name] + list(plugin.get(table, []))
        self.protected += plugin.get("protected_members", [])

    def __getattr__(self, name: str) -> DataFrame:
        if name not in _SCHEMAS:
            raise AttributeError(name)
        return self.spark.createDataFrame(self.tables[name], _SCHEMAS[name])

    def names(self) -> list[str]:
        return sorted({r[0] for r in self.tables["activations"]})


def activations(spark: SparkSession) -> DataFrame:
    return Rules(spark).activations


def packages(spark: SparkSession) -> DataFrame:
    return Rules(spark).packages


def config_files(spark: SparkSession) -> DataFrame:
    return Rules(spark).config_files


def routes(spark: SparkSession) -> DataFrame:
    return Rules(spark).routes


def contracts(spark: SparkSession) -> DataFrame:
    return Rules(spark).contracts


def needles(spark: SparkSession) -> DataFrame:
    return Rules(spark).needles


def programs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_PROGRAMS.items()), "bin string, package string")


def popular(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in POPULAR], "package string")


def migrations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MIGRATIONS, "legacy string, modern string, reason string")


def folders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_FOLDERS, "plugin string, folder string, package string")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_TEMPLATES, "plugin string, file_name string, template string")


def define(name: str, activation: str = "dep", packages: tuple = (), routes: tuple = (), contracts: tuple = ("default",), configs: tuple = (), needles: tuple = (), protected_members: tuple = ()) -> dict[str, list[tuple]]:
    """Rows of one more plugin for each rule table, for `Rules.register`. Packages are names, or (name, for development,
    optional); ``protected_members`` are class members that the framework calls."""
    return {
        "activations": [(name, activation)],
        "packages": [(name, p, False, False) if isinstance(p, str) else (name, *p) for p in packages],
        "routes": [(name, r) for r in routes],
        "contracts": [(name, c) for c in contracts],
        "config_files": [(name, c) for c in configs],
        "needles": [(name, n) for n in needles],
        "protected_members": list(protected_members),
    }


def protect_members(names: list[str]):
    """A filter for dead members: those named are used from outside."""
    return lambda dead: dead.where(~dead["member"].isin(*names)) if names else dead
