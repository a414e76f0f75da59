"""Exclude patterns for kinds of projects, and other names of these kinds."""

from __future__ import annotations

#: The folder of this library's own hooks is excluded too.
PRODUCT = "veilmark"

TEMPLATES: dict[str, list[str]] = {
    "common": [
        "*.lock", ".DS_Store", "Thumbs.db", "Desktop.ini", "**/dist/**", "**/build/**", "**/coverage/**", "*.map", "*.min.js", "*.min.css", ".eslintcache", ".stylelintcache", f".{PRODUCT}/hooks/**",
        "**/*.png", "**/*.gif", "**/*.jpg", "**/*.jpeg", "**/*.ico", "**/*.webp", "**/*.icns",
    ],
    "node": [
        "**/node_modules/**", "**/.next/**", "**/.nuxt/**", "**/.output/**", "**/.turbo/**", "**/.vercel/**", "**/bower_components/**", "**/.yarn/cache/**", "**/.yarn/unplugged/**", "**/.pnpm-store/**",
        "**/.svelte-kit/**", "**/.parcel-cache/**", "**/.vite/**", "**/storybook-static/**", "package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "bun.lock", "bun.lockb", "install-state.gz", "*.tsbuildinfo",
    ],
    "python": [
        "**/.venv/**", "**/venv/**", "**/__pycache__/**", "**/.mypy_cache/**", "**/.pytest_cache/**", "**/.ruff_cache/**", "**/*.egg-info/**", "**/.tox/**", "**/.eggs/**", "**/.nox/**", "**/htmlcov/**",
        "**/.ipynb_checkpoints/**", "*.pyc", "*.pyo",
    ],
    "go": ["**/vendor/**", "go.sum"],
    "rust": ["**/target/**"],
    "ruby": ["**/vendor/bundle/**", "**/.bundle/**"],
    "java": ["**/.gradle/**", "**/out/**", "**/.idea/**", "**/target/**", "*.class", "*.jar"],
    "android": ["**/.cxx/**", "**/.externalNativeBuild/**", "*.apk", "*.aab", "*.dex", "*.class", "*.jar"],
    "swift": ["**/DerivedData/**", "**/.build/**", "**/Pods/**", "**/Carthage/Build/**", "**/xcuserdata/**", "*.xcuserstate", "*.xcarchive/**", "Package.resolved", "*.ipa", "**/*.dSYM/**"],
    "tuist": ["**/Derived/**", "**/Tuist/.build/**", "**/Tuist/Dependencies/**", "**/.tuist-bin/**", "**/.tuist-generated", ".package.resolved"],
}
ALIASES = {"js": "node", "ts": "node", "javascript": "node", "typescript": "node", "ios": "swift"}
