"""Rating and serve walks: ordered folds whose state is a few numbers for each player, and the point model."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from matchlake.functions.scalars import BLEND, K, K_OFFSET, K_SHAPE, MOV, MOV_CAP, SCALE, START, SURFACE_K

SURFACES = ("Hard", "Clay", "Grass")


@dataclass(frozen=True)
class Rating:
    """Settings of a rating walk; as they are by default, the rules from ``transfer`` on change nothing."""

    k: float = K
    offset: float = K_OFFSET
    shape: float = K_SHAPE
    surface_k: float = SURFACE_K
    surface_offset: float = K_OFFSET
    surface_shape: float = K_SHAPE
    blend: float = BLEND
    margin: float = MOV
    cap: float = MOV_CAP
    form_days: float = 90.0
    transfer: float = 0.0  # share of a surface's update that other surfaces get
    blend_half: float = 0.0  # matches on a surface at which half the blend counts
    home: float = 0.0  # points for playing at home, in the expectation of updates only
    skip_walkovers: bool = False
    retired: float = 1.0  # weight of matches that were given up
    layoff_days: float = 0.0  # days off after which the first match counts more
    layoff_boost: float = 0.0
    best_of_5: float = 1.0  # stretch of rating differences in long matches

    @property
    def keep_days(self) -> float:
        """Days that a form snapshot is kept for."""
        return max(120.0, self.form_days * 4 / 3)


#: The tuned settings of the two tours.
ATP = Rating(k=145, offset=5, shape=0.21, surface_k=52, surface_shape=0.33, blend=0.63, margin=0.22, cap=2.0, layoff_days=400, layoff_boost=0.44, best_of_5=1.28, transfer=0.27)
WTA = Rating(k=320, offset=1.5, shape=0.37, surface_k=45, surface_shape=0.40, blend=0.62, margin=0.22, cap=1.65, retired=0.72, layoff_days=86, layoff_boost=0.16, transfer=0.17, form_days=65)

ELO = (
    "match_id bigint, tour int, winner bigint, loser bigint, date date, surface string, w_elo double, l_elo double, w_selo double, l_selo double, p_blend double, w_after double, l_after double, w_n int, l_n int, "
    "w_belo double, l_belo double, p_overall double, p_surface double, w_form double, l_form double, counted boolean"
)


def chance(difference: float) -> float:
    return 1 / (1 + 10 ** (-difference / SCALE))


class Rated:
    """What the rating walk knows of a player: ratings, matches and last day, and the ratings of the last months."""

    __slots__ = ("elo", "n", "day", "local", "on", "days", "values")

    def __init__(self) -> None:
        self.elo, self.n, self.day = START, 0, None
        self.local: dict[str, float] = {}
        self.on: dict[str, int] = {}
        self.days: list[int] = []
        self.values: list[float] = []

    def packed(self) -> list[float]:
        """The state as numbers: elo, matches, day, then rating and matches of each surface, then days and ratings of the
        last months (RATED_AT has the places; what isn't there is no number)."""
        none = math.nan
        surfaces = [x for k in SURFACES for x in (self.local.get(k, none), float(self.on.get(k, 0)))]
        return [self.elo, float(self.n), none if self.day is None else float(self.day), *surfaces, *map(float, self.days), *self.values]

    @classmethod
    def unpacked(cls, numbers: list[float]) -> Rated:
        own, rest = cls(), numbers[3 + 2 * len(SURFACES) :]
        own.elo, own.n, own.day = numbers[0], int(numbers[1]), None if math.isnan(numbers[2]) else int(numbers[2])
        for i, k in enumerate(SURFACES):
            rating, n = numbers[3 + 2 * i], int(numbers[4 + 2 * i])
            own.local |= {} if math.isnan(rating) else {k: rating}
            own.on |= {k: n} if n else {}
        own.days, own.values = [int(x) for x in rest[: len(rest) // 2]], list(rest[len(rest) // 2 :])
        return own


class RatingWalk:
    """Overall and surface ratings: what they are before each match, then the update of both sides.

    Recorded chances know no venue; only the update's expectation has the home bonus. Ratings after a match that is not
    counted are those before it. With several settings, tours take turns in them. ``known`` gives the state of a player
    that hasn't been met yet, so that a walk goes on from states that were saved.
    """

    def __init__(self, *settings: Rating, known: Callable[[int], list[float] | None] = lambda _: None):
        self.settings, self.known = settings, known
        self.players: dict[int, Rated] = {}

    def packed(self, player: int) -> list[float]:
        return self.players[player].packed()

    def of(self, player: int) -> Rated:
        own = self.players.get(player)
        if own is None:
            saved = self.known(player)
            own = self.players[player] = Rated() if saved is None else Rated.unpacked(saved)
        return own

    def step(self, match_id, tour, winner, loser, date, day, surface, tier_k, w_games, l_games, completed, walkover, best_of, w_home, l_home) -> tuple:
        return self.walked(True, match_id, tour, winner, loser, date, day, surface, tier_k, w_games, l_games, completed, walkover, best_of, w_home, l_home)

    def foretold(self, played, match_id, tour, winner, loser, date, day, surface, tier_k, w_games, l_games, completed, walkover, best_of, w_home, l_home) -> tuple | None:
        """A step for a match that was played, which gives no row; else the row of a match to come, which changes nothing."""
        row = self.walked(played, match_id, tour, winner, loser, date, day, surface, tier_k, w_games, l_games, completed, walkover, best_of, w_home, l_home)
        return None if played else row

    def walked(self, played, match_id, tour, winner, loser, date, day, surface, tier_k, w_games, l_games, completed, walkover, best_of, w_home, l_home) -> tuple:
        s = self.settings[tour % len(self.settings)]
        w, l = self.of(winner), self.of(loser)
        we, le = w.elo, l.elo
        ws, ls = w.local.get(surface, we), l.local.get(surface, le)
        wn, ln = w.n, l.n
        wsn, lsn = w.on.get(surface, 0), l.on.get(surface, 0)
        wide = [s.blend * n / (n + s.blend_half) if s.blend_half > 0 else s.blend for n in (wsn, lsn)]
        wb, lb = (1 - wide[0]) * we + wide[0] * ws, (1 - wide[1]) * le + wide[1] * ls
        stretch = s.best_of_5 if best_of == 5 else 1.0
        p, q = chance((we - le) * stretch), chance((ws - ls) * stretch)
        out = (wb, lb, p, q, self.change(s, w, day), self.change(s, l, day))
        head = (match_id, tour, winner, loser, date, surface, we, le, ws, ls, chance((wb - lb) * stretch))
        if not played or walkover and s.skip_walkovers:
            return *head, we, le, wn, ln, *out, False
        weight = tier_k * (1.0 if completed or walkover else s.retired)
        if completed:
            weight *= min(1 + s.margin * math.log1p(abs(w_games - l_games)), s.cap)
        if w_home or l_home:
            p, q = chance((we + s.home * w_home - le - s.home * l_home) * stretch), chance((ws + s.home * w_home - ls - s.home * l_home) * stretch)
        for own, sign, rating, local, n, sn in ((w, 1, we, ws, wn, wsn), (l, -1, le, ls, ln, lsn)):
            gap = 0 if own.day is None else day - own.day
            more = weight * (1 + s.layoff_boost * min(gap / 365, 2.0) if s.layoff_days > 0 and gap > s.layoff_days else 1.0)
            own.elo = rating + sign * s.k / (n + s.offset) ** s.shape * more * (1 - p)
            step_on = sign * s.surface_k / (sn + s.surface_offset) ** s.surface_shape * more * (1 - q)
            own.local[surface] = local + step_on
            for other in SURFACES if s.transfer > 0 else ():
                if other != surface:
                    own.local[other] = own.local.get(other, rating) + s.transfer * step_on
            own.n, own.on[surface], own.day = n + 1, sn + 1, day
            own.days.append(day)
            own.values.append(own.elo)
            if own.days[0] < day - s.keep_days:
                old = bisect_right(own.days, day - s.keep_days - 1)
                del own.days[:old], own.values[:old]
        return *head, w.elo, l.elo, wn + 1, ln + 1, *out, True

    @staticmethod
    def change(s: Rating, own: Rated, day: int) -> float:
        """The rating now less the last one ``form_days`` ago or before."""
        at = bisect_right(own.days, day - s.form_days)
        return own.elo - own.values[at - 1] if at else 0.0

    def recorded(self, match_id, tour, winner, loser, date, day, surface, tier_k, w_games, l_games, completed, walkover, best_of, w_home, l_home) -> tuple:
        """A step, with both states after it."""
        row = self.step(match_id, tour, winner, loser, date, day, surface, tier_k, w_games, l_games, completed, walkover, best_of, w_home, l_home)
        return *row, self.players[winner].packed(), self.players[loser].packed()


#: Places in a packed state, and where its months begin (counted from 0).
RATED_AT = {"elo": 0, "n": 1, "day": 2} | {f"{x}_{k}": 3 + 2 * i + j for i, k in enumerate(SURFACES) for j, x in enumerate(("elo", "n"))}
RATED_HEAD = 3 + 2 * len(SURFACES)
STATES = "w_state array<double>, l_state array<double>"


#: What a walk that has ended tells of a player it met: rows beside those of matches.
LEFT = "state array<double>"


def left(tour: int, step: Callable[..., tuple], width: int) -> Iterator[tuple]:
    """Rows as wide as a walk's and then the packed state, of all players that its step met: no match, the tour, the player as winner."""
    walk = step.__self__
    for player in walk.players:
        yield None, tour, player, *(None,) * (width - 3), walk.packed(player)


def rating_walk(*settings: Rating) -> Callable[[], Callable[..., tuple]]:
    return lambda: RatingWalk(*settings).step


def rating_history(*settings: Rating) -> Callable[[], Callable[..., tuple]]:
    """The walk with both states after each match (columns ELO, then STATES)."""
    return lambda: RatingWalk(*settings).recorded


class Arms:
    """The rating walk under many settings at once: what is a number for a player there is a row of an array here, a column for
    each setting. Matches of a batch whose players have no earlier match left in it are taken at once, so a batch costs as
    many array steps as the longest chain of matches in it."""

    def __init__(self, settings: list[Rating]):
        self.s = {k: np.array([float(getattr(x, k)) for x in settings]) for k in Rating.__dataclass_fields__}
        self.width, self.place, self.room = len(settings), {}, 0
        self.state: dict = {}

    def _places(self, players: list) -> np.ndarray:
        """Rows of the players in the state (elo, matches and day, then rating and matches of each surface; no number: none yet)."""
        place = self.place
        out = np.array([place.setdefault(x, len(place)) for x in players])
        if len(place) > self.room:
            more = max(1024, self.room, len(place) - self.room)
            start = {"elo": START, "n": 0.0, "day": math.nan} | {(k, x): y for k in SURFACES for x, y in (("elo", math.nan), ("n", 0.0))}
            grown = {k: np.full((more, self.width), v) for k, v in start.items()}
            self.state = {k: np.concatenate([self.state[k], v]) if self.room else v for k, v in grown.items()}
            self.room += more
        return out

    def step(self, match_id, tour, winner, loser, day, surface, tier_k, w_games, l_games, completed, walkover, best_of, w_home, l_home) -> tuple:
        """match_id, tour and the blended chance of the winner under each setting."""
        return match_id, tour, self.chances(*[[x] for x in (winner, loser, day, surface, tier_k, w_games, l_games, completed, walkover, best_of, w_home, l_home)])[0].tolist()

    def chances(self, winner, loser, day, surface, tier_k, w_games, l_games, completed, walkover, best_of, w_home, l_home) -> np.ndarray:
        """The blended chance of the winner under each setting, a row a match, of matches in order."""
        number = lambda x: np.array([0.0 if y is None else y for y in x], float)[:, None]
        w, l = self._places(winner), self._places(loser)
        turn, last = np.empty(len(w), int), {}
        for i, (a, b) in enumerate(zip(w.tolist(), l.tolist(), strict=True)):
            turn[i] = last[a] = last[b] = max(last.get(a, -1), last.get(b, -1)) + 1
        done, void = np.array([x is True or x == 1 for x in completed])[:, None], np.array([x is True or x == 1 for x in walkover])[:, None]
        games = np.log1p(np.abs(np.where(done, number(w_games) - number(l_games), 0.0)))
        given = {"w": w, "l": l, "day": number(day), "tier": number(tier_k), "games": games, "done": done, "void": void, "long": number(best_of) == 5, "home": np.nan_to_num(number(w_home)) - np.nan_to_num(number(l_home))}
        own, out = np.array(surface), np.empty((len(w), self.width))
        order = np.argsort(turn, kind="stable")
        for at in np.split(order, np.cumsum(np.bincount(turn))[:-1]):
            for k in np.unique(own[at]).tolist():
                these = at[own[at] == k]
                out[these] = self._together(k, **{x: v[these] for x, v in given.items()})
        return out

    def _together(self, surface, w, l, day, tier, games, done, void, long, home) -> np.ndarray:
        """Matches on one surface in which nobody plays twice."""
        s, all_ = self.s, self.state
        stretch = np.where(long, s["best_of_5"], 1.0)
        even = lambda d: 1 / (1 + 10 ** (-d * stretch / SCALE))
        rating, local, blended = [], [], []
        for own in (w, l):
            here, n = all_[surface, "elo"][own], all_[surface, "n"][own]
            rating.append(all_["elo"][own])
            local.append(np.where(np.isnan(here), rating[-1], here))
            wide = np.where(s["blend_half"] > 0, s["blend"] * n / np.maximum(n + s["blend_half"], 1e-300), s["blend"])
            blended.append((1 - wide) * rating[-1] + wide * local[-1])
        counted = ~((s["skip_walkovers"] > 0) & void)
        weight = tier * np.where(done | void, 1.0, s["retired"])
        weight = np.where(done, weight * np.minimum(1 + s["margin"] * games, s["cap"]), weight)
        home = s["home"] * home
        miss, miss_on = 1 - even(rating[0] - rating[1] + home), 1 - even(local[0] - local[1] + home)
        for i, (own, sign) in enumerate(((w, 1.0), (l, -1.0))):
            n, on = all_["n"][own], all_[surface, "n"][own]
            gap = np.nan_to_num(day - all_["day"][own])
            late = np.where((s["layoff_days"] > 0) & (gap > s["layoff_days"]), 1 + s["layoff_boost"] * np.minimum(gap / 365, 2.0), 1.0)
            move = sign * s["k"] / (n + s["offset"]) ** s["shape"] * weight * late * miss
            move_on = sign * s["surface_k"] / (on + s["surface_offset"]) ** s["surface_shape"] * weight * late * miss_on
            for other in SURFACES:
                now = all_[other, "elo"][own]
                if other == surface:
                    all_[other, "elo"][own] = np.where(counted, local[i] + move_on, now)
                else:
                    here = np.where(np.isnan(now), rating[i], now)
                    all_[other, "elo"][own] = np.where(counted & (s["transfer"] > 0), here + s["transfer"] * move_on, now)
            all_["elo"][own] = np.where(counted, rating[i] + move, rating[i])
            all_["n"][own], all_[surface, "n"][own] = n + counted, on + counted
            all_["day"][own] = np.where(counted, day, all_["day"][own])
        return even(blended[0] - blended[1])


@dataclass(frozen=True)
class Serve:
    """Settings of a serve walk: half-life of credit in days, and points of shrinkage toward the league, toward the player's
    own level on all surfaces, and toward no effect of the venue (0: venues are not told apart)."""

    half_life: float = 540.0
    shrink: float = 200.0
    surface_shrink: float = 120.0
    venue_shrink: float = 0.0


#: The tuned settings of the two tours, and the bounds of a point's chance.
SERVE_ATP, SERVE_WTA = Serve(200, 600, 1400), Serve(200, 550, 3000)
CLIP = (0.05, 0.95)

SERVE = "match_id bigint, tour int, winner bigint, loser bigint, date date, best_of int, w_serve double, l_serve double, w_return double, l_return double, w_points double, l_points double, pa double, pb double"


class ServeWalk:
    """Decayed serve and return skills by surface, each adjusted for the opponent's skill read before the update, and what
    venues add to everybody's serve.

    average and base: serve points won in the league, and by surface. With several settings, tours take turns in them.
    """

    #: Of a player: the day, then won and served on serve, won and received on return, over all and by surface.
    KEYS = (None, *SURFACES)

    def __init__(self, *settings: Serve, average: float, base: dict[str, float], known: Callable[[int], list[float] | None] = lambda _: None, venue: Callable[[str, str], list[float] | None] = lambda *_: None):
        self.settings, self.average, self.base, self.known, self.venue = settings, average, base, known, venue
        self.players: dict[int, list] = {}
        self.venues: dict[tuple, list[float]] = {}

    def packed(self, player: int) -> list[float]:
        day, totals = self.players[player]
        return [float(day), *[x for k in self.KEYS for x in totals.get(k, (0.0,) * 4)]]

    def of(self, player: int, day: int, half_life: float) -> dict:
        own = self.players.get(player)
        if own is None:
            saved = self.known(player)
            own = [day, {}] if saved is None else [int(saved[0]), {k: list(saved[4 * i + 1 : 4 * i + 5]) for i, k in enumerate(self.KEYS)}]
            self.players[player] = own
        if day > own[0]:
            factor = 0.5 ** ((day - own[0]) / half_life)
            for t in own[1].values():
                t[:] = [x * factor for x in t]
        own[0] = day
        return own[1]

    def skills(self, s: Serve, totals: dict, surface: str) -> tuple[float, float, float, float]:
        """Serve and return over all, then on the surface."""
        average, none = self.average, (0.0,) * 4
        sw, sp, rw, rp = totals.get(None, none)
        serve = (sw + average * s.shrink) / (sp + s.shrink) - average
        back = (rw + (1 - average) * s.shrink) / (rp + s.shrink) - (1 - average)
        if surface not in self.base:
            return serve, back, serve, back
        sw, sp, rw, rp = totals.get(surface, none)
        level = self.base[surface]
        local = (sw + (level + serve) * s.surface_shrink) / (sp + s.surface_shrink) - level
        local_back = (rw + (1 - level + back) * s.surface_shrink) / (rp + s.surface_shrink) - (1 - level)
        return serve, back, local, local_back

    def foretold(self, played, match_id, tour, winner, loser, date, day, surface, event, best_of, w_svpt, w_won, l_svpt, l_won) -> tuple | None:
        """A step for a match that was played, which gives no row; else the row of a match to come, whose points are zeros: it
        brings its sides' totals to its day and adds nothing."""
        row = self.step(match_id, tour, winner, loser, date, day, surface, event, best_of, w_svpt, w_won, l_svpt, l_won)
        return None if played else row

    def step(self, match_id, tour, winner, loser, date, day, surface, event, best_of, w_svpt, w_won, l_svpt, l_won) -> tuple:
        s = self.settings[tour % len(self.settings)]
        mine, other = self.of(winner, day, s.half_life), self.of(loser, day, s.half_life)
        gsw, grw, sw, rw = self.skills(s, mine, surface)
        gsl, grl, sl, rl = self.skills(s, other, surface)
        level, won, n, shift = self.base.get(surface, self.average), 0.0, 0.0, 0.0
        if s.venue_shrink > 0:
            won, n = self.venues.get((event, surface)) or self.venue(event, surface) or (0.0, 0.0)
            shift = won / (n + s.venue_shrink)
        pa, pb = (min(max(level + shift + x, CLIP[0]), CLIP[1]) for x in (sw - rl, sl - rw))
        out = (match_id, tour, winner, loser, date, best_of, sw, sl, rw, rl, mine.get(None, (0, 0.0))[1], other.get(None, (0, 0.0))[1], pa, pb)
        if w_svpt and l_svpt and w_svpt > 0 and l_svpt > 0:
            for totals, own, ours, theirs, lost, back, serve in ((mine, w_svpt, w_won, l_svpt, l_won, grl, gsl), (other, l_svpt, l_won, w_svpt, w_won, grw, gsw)):
                more = ((ours / own + back - shift) * own, own, ((theirs - lost) / theirs + serve + shift) * theirs, theirs)
                for key in (None, surface):
                    totals[key] = [x + y for x, y in zip(totals.get(key, (0.0, 0.0, 0.0, 0.0)), more, strict=True)]
            if s.venue_shrink > 0:
                pool = w_svpt + l_svpt
                expected = level + ((sw - rl) * w_svpt + (sl - rw) * l_svpt) / pool
                self.venues[event, surface] = [won + (w_won + l_won) - expected * pool, n + pool]
        return out


def game(p: np.ndarray) -> np.ndarray:
    """Chance to win a service game when each point is won with chance p."""
    q = 1 - p
    return p**4 * (1 + 4 * q + 10 * q * q) + 20 * (p * q) ** 3 * p * p / (1 - 2 * p * q)


def tiebreak(serve: np.ndarray, back: np.ndarray, to: int = 7) -> np.ndarray:
    """Chance to win a tie-break for the side that serves first, from its points won on serve and on return."""
    level = serve * back / (serve * back + (1 - serve) * (1 - back))
    row = [np.ones_like(serve)] * (to + 1)  # of scores (to, b)
    for a in range(to - 1, -1, -1):
        new = [row[0]] * (to + 1)
        new[to] = np.zeros_like(serve)
        for b in range(to - 1, -1, -1):
            p = serve if (a + b + 1) // 2 % 2 == 0 else back
            new[b] = level if a == b == to - 1 else p * row[b] + (1 - p) * new[b + 1]
        row = new
    return row[0]


def set_chance(serve: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Chance to win a set for the side that serves first, by points won on serve and on return, from the last games back."""
    won, lost = np.ones_like(serve), np.zeros_like(serve)
    own, gained = game(serve), 1 - game(1 - back)
    value = {(7, b): won for b in range(7)} | {(a, 7): lost for a in range(7)} | {(6, b): won for b in range(5)} | {(a, 6): lost for a in range(5)}
    value[6, 6] = tiebreak(serve, back)
    for total in range(11, -1, -1):
        p = own if total % 2 == 0 else gained
        for a in range(max(0, total - 6), min(6, total) + 1):
            score = (a, total - a)
            if score not in value:
                value[score] = p * value[a + 1, total - a] + (1 - p) * value[a, total - a + 1]
    return value[0, 0]


def point_match(pa: np.ndarray, pb: np.ndarray, best_of: np.ndarray) -> np.ndarray:
    """Chance to win a match from both sides' points won on serve (four decimals), whoever serves first."""
    a, b = (np.clip(np.round(p, 4), *CLIP) for p in (pa, pb))
    one = (set_chance(a, 1 - b) + 1 - set_chance(b, 1 - a)) / 2
    return np.where(best_of == 5, one**3 * (10 - 15 * one + 6 * one * one), one * one * (3 - 2 * one))
